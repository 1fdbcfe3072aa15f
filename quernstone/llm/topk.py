"""Exact top-k inner products over norm-sorted vectors.

Candidates are dealt by descending length into blocks that stay where they are: a candidate is in one block, and is sent there once.  First
every query meets the longest vectors of all, a bounded set; its k-th best score there is a floor that it carries on.  By
Cauchy-Schwarz a block whose longest vector times the query's length stays under the floor holds none of its k best, so a query goes only to
the blocks before that.  A block's task holds its candidates and reads the queries that reach it as a stream.

In a block the candidates come by descending length, in chunks.  A chunk whose longest vector times a query's length stays under that
query's k-th best score so far ends the query's search there.  Otherwise partial sums over the leading axes of an SVD rotation, plus
the product of the two residual lengths, bound each score from above; only pairs whose bound reaches the k-th best get their exact
integer product.  A query's best of all its blocks are merged by a window over its own few rows.

The rotation comes from a bounded sample: any orthogonal matrix gives the same result and only prunes more or less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, small_batches, table

K = 5
QUERY_EVERY = 50
SCALE = 256
CANDIDATES_IN_BLOCK = 32_768
#: Queries are handled so many at a time; a block with more than QUERIES_IN_TASK of them is worked on by several tasks.
QUERIES_AT_ONCE = 2_048
QUERIES_IN_TASK = 262_144
#: Lengths fall into at most so many bands, cut at quantiles; a band has one block or more.
BANDS = 256
#: How many of the longest vectors every query meets first.
FIRST = 4_096
CHUNK = 1024
LEVELS = (0.25, 0.5, 0.75)
SAMPLE = 8192
DENSE = 0.25


#: A product of two vectors whose lengths multiply to less fits 64 bits for sure.
SURE = 9.2e18
#: The id of rows that have none, while they are searched; ties go to it last.
NO_ID = (1 << 63) - 1


class ScoreOverflow(ArithmeticError):
    """The integer product of two vectors doesn't fit 64 bits."""


def wide_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows in whole numbers of any size; one that doesn't fit 64 bits is refused."""
    out = [sum(map(int.__mul__, x, y)) for x, y in zip(q.tolist(), c.tolist(), strict=True)]
    if any(not -(1 << 63) <= s < 1 << 63 for s in out):
        raise ScoreOverflow("the product of a query and a candidate doesn't fit a long")
    return np.array(out, dtype=np.int64)


def best_k(owner: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k best, larger score first, then smaller id."""
    order = np.lexsort((ident, -score, owner))
    o = owner[order]
    first = np.concatenate(([True], o[1:] != o[:-1])) if len(o) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
    return order[np.arange(len(o)) - start < k]


def search_cell(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, axes: np.ndarray, k: int = K, chunk: int = CHUNK, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """(query position, candidate id, score) of each query's k best among the candidates, and how many pairs were computed.

    q and c hold integers (int64).  A candidate with the query's own id takes no part.  `least`: a score for each query that its k best reach
    for sure; what is under it may be left out.
    """
    d = q.shape[1]
    stats = {"pairs": len(q) * len(c), "exact": 0}
    fits = (np.abs(q).max(initial=0).astype(float) * np.abs(c).max(initial=0).astype(float) * d) < 2.0**52
    kind = np.float64 if fits else np.int64  # products and sums in doubles are exact below 2^52
    qx, cx = q.astype(kind), c.astype(kind)
    q_len, c_len = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((c.astype(float) ** 2).sum(1))
    order = np.lexsort((c_id, -c_len))
    cx, c_id, c_len = cx[order], c_id[order], c_len[order]
    qr, cr = q.astype(float) @ axes, c[order].astype(float) @ axes
    cuts = sorted({max(1, int(d * f)) for f in LEVELS}) if d > 3 else []
    rest = lambda x: {h: np.sqrt((x[:, h:] ** 2).sum(1)) for h in cuts}
    q_rest, c_rest = rest(qr), rest(cr)
    least = np.full(len(q), -np.inf) if least is None else least
    floor = least
    owner, score, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(c_id), chunk):
        b = min(a + chunk, len(c_id))
        slack = 1e-6 + 1e-9 * q_len * c_len[a]
        live = np.flatnonzero(q_len * c_len[a] + slack >= floor)
        if not len(live):
            break
        full = True
        if cuts and np.isfinite(floor[live]).any():
            h = cuts[0]
            bound = qr[live, :h] @ cr[a:b, :h].T + np.outer(q_rest[h][live], c_rest[h][a:b]) + slack[live, None]
            i, j = np.nonzero(bound >= floor[live, None])
            full = len(i) > DENSE * bound.size
            if not full:
                i = live[i]
                j += a
                part = np.einsum("ij,ij->i", qr[i, :h], cr[j, :h])
                for g, h2 in zip(cuts, cuts[1:], strict=False):
                    part = part + np.einsum("ij,ij->i", qr[i, g:h2], cr[j, g:h2])
                    keep = part + q_rest[h2][i] * c_rest[h2][j] + slack[i] >= floor[i]
                    i, j, part = i[keep], j[keep], part[keep]
                s = np.einsum("ij,ij->i", qx[i], cx[j]).astype(np.int64)
                wide = np.flatnonzero(q_len[i] * c_len[j] >= SURE)
                s[wide] = wide_products(qx[i[wide]], cx[j[wide]])
                stats["exact"] += len(i)
        if full:
            dense = qx[live] @ cx[a:b].T
            if q_len[live].max(initial=0) * c_len[a] >= SURE:
                u, v = np.nonzero((np.outer(q_len[live], c_len[a:b]) >= SURE) & (c_id[None, a:b] != q_id[live, None]))
                dense[u, v] = wide_products(qx[live[u]], cx[a + v])
            stats["exact"] += dense.size
            dense[c_id[None, a:b] == q_id[live, None]] = np.iinfo(np.int64).min
            low = floor[live]
            if b - a > k:  # what is under the chunk's own k-th best can't stay
                low = np.maximum(low, np.partition(dense, b - a - k, axis=1)[:, b - a - k])
            i, j = np.nonzero(dense >= low[:, None])
            s = dense[i, j].astype(np.int64)
            i, j = live[i], j + a
        other = c_id[j] != q_id[i]
        i, j, s = i[other], j[other], s[other]
        owner, score, found = np.concatenate((owner, i)), np.concatenate((score, s)), np.concatenate((found, c_id[j]))
        top = best_k(owner, score, found, k)
        owner, score, found = owner[top], score[top], found[top]
        many = np.bincount(owner, minlength=len(q))
        worst = np.full(len(q), np.inf)
        np.minimum.at(worst, owner, score)
        floor = np.maximum(least, np.where(many >= k, worst, -np.inf))
    return owner, found, score, stats


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of integers, short ones filled up with zeros."""
    flat = column.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.flatten().to_numpy()
    return out


def blocks_of(bands: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """From each band's number of rows: its first block and its number of blocks.  Small neighbours share one."""
    out, n_blocks, room = {}, 0, 0
    for b in sorted(bands):
        if bands[b] <= room:
            out[b], room = (n_blocks - 1, 1), room - bands[b]
            continue
        many = -(-bands[b] // size)
        out[b] = (n_blocks, many)
        n_blocks, room = n_blocks + many, many * size - bands[b] if many == 1 else 0
    return out




def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", candidates_in_block: int = CANDIDATES_IN_BLOCK, queries_in_task: int = QUERIES_IN_TASK, first: int = FIRST, bands: int = BANDS
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products, ties to the smaller id.

    Components become floor(256 * x).  Vectors null or with null or non-finite components take no part; shorter vectors, empty ones too, count as
    filled up with zeros.  Rows may share an id; a query meets no row with its own.  Rows without an id are candidates, the last of equal ones, and no
    queries.  A component or a product that is met and doesn't fit a long raises ScoreOverflow; no pair else is refused.  Other columns are not read.
    An empty table, and one without queries, gives no rows.
    Beside the candidates' own shuffle, a query is copied once for each block that its bound reaches.
    """
    spark = vectors.sparkSession
    x, stage = F.col("x"), Stage(spark)
    fine = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"), (is_query & F.col(id_col).isNotNull()).alias("is_query")).where(x.isNotNull() & fine)
    floors = ok.select("vec_id", F.transform("x", lambda v: F.floor(v.cast("double") * SCALE).cast("double")).alias("f"), "is_query")
    length = F.sqrt(F.aggregate("f", F.lit(0.0), lambda a, v: a + v * v))
    rows = stage.keep(floors.select(F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "is_query", length.alias("length"), F.coalesce(F.array_max(F.transform("f", lambda v: F.abs(v))), F.lit(0.0)).alias("top"), F.transform("f", lambda v: F.when(F.abs(v) < 2.0**62, v).otherwise(0.0).cast("long")).alias("v")), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q"), F.max(F.size("v")).alias("d"), F.max("length").alias("far"), F.max("top").alias("top")).first()
    n, nq, d = size["n"] or 0, size["q"] or 0, size["d"] or 0
    if not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if size["top"] >= 2.0**62:
        raise ScoreOverflow(f"a component of {size['top']:.4g} (times {SCALE}) doesn't fit a long")
    d = max(d, 1)
    u = F.xxhash64(F.lit(5), "vec_id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    some = rows.where(u * n < SAMPLE).select("v").limit(2 * SAMPLE).toArrow()
    m = matrix(some["v"], d).astype(float)
    axes = np.linalg.eigh(m.T @ m)[1][:, ::-1].copy() if len(m) else np.eye(d)  # right singular vectors, largest first
    top = rows.orderBy(F.col("length").desc(), "vec_id").select("vec_id", "v").limit(max(1, min(first, (1 << 22) // d))).toArrow()
    top_id, top_v = top["vec_id"].to_numpy(), matrix(top["v"], d)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the k-th best score among the longest vectors as their floor; null where there are fewer than k."""
        for batch in batches:
            for low in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(low, QUERIES_AT_ONCE)
                ids = part.column(0).to_numpy()
                owner, _, score, _ = search_cell(ids, matrix(pa.chunked_array([part.column(2)]), d), top_id, top_v, axes, k)
                least, many = np.full(len(ids), np.iinfo(np.int64).max), np.bincount(owner, minlength=len(ids))
                np.minimum.at(least, owner, score)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least, mask=many < k)], names=["vec_id", "length", "v", "least"])

    asking = rows.where("is_query").select("vec_id", "length", "v").mapInArrow(meet, "vec_id long, length double, v array<long>, least long")
    # bands by descending length; a band's blocks are chosen by a hash
    cuts = sorted(set(rows.agg(F.percentile_approx("length", [i / bands for i in range(1, bands)], 10_000)).first()[0] or []), reverse=True)
    cuts = cuts[: bands - 1]
    cut = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    banded = rows.withColumn("band", F.size(F.filter(cut, lambda c: c > F.col("length"))))
    found = {r["band"]: (r["n"], r["far"]) for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("far")).collect()}  # at most `bands` rows
    placed = blocks_of({b: many for b, (many, _) in found.items()}, candidates_in_block)
    of_band = spark.createDataFrame([(b, first_block, many) for b, (first_block, many) in placed.items()], "band int, first_block int, many int")
    splits = max(1, -(-nq // queries_in_task))
    every = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    block = (F.col("first_block") + F.pmod(F.xxhash64(F.lit(6), "vec_id"), F.col("many"))).cast("int")
    candidates = banded.join(F.broadcast(of_band), "band").select(block.alias("block"), every.alias("split"), F.lit(0).alias("as_query"), "vec_id", "v", F.lit(None).cast("long").alias("least"))
    # a band holds none of the k best where |query| * its longest < floor; so a query goes to the bands, and their blocks, before that
    far = F.array(*[F.lit(float(found[b][1])) for b in sorted(found)])
    upto = F.array(*[F.lit(sum(placed[b])) for b in sorted(found)])
    reached = F.size(F.filter(far, lambda r: F.col("least").isNull() | (F.col("length") * r * (1 + 1e-9) + 1e-6 >= F.col("least"))))
    near = F.when(reached > 0, F.get(upto, reached - 1)).otherwise(0)
    split = F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(splits)).cast("int")
    queries = asking.withColumn("near", near).where("near > 0").select(F.explode(F.sequence(F.lit(0), F.col("near") - 1)).alias("block"), split.alias("split"), F.lit(1).alias("as_query"), "vec_id", "v", "least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, have, c_id, c = None, [], None, None
        for batch in batches:
            t = pa.table(batch)
            at = np.column_stack([t["block"].to_numpy(), t["split"].to_numpy(), t["as_query"].to_numpy()])
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for a, b in zip(edges, edges[1:], strict=False):
                for low in range(a, b, QUERIES_AT_ONCE):
                    part = t.slice(low, min(b, low + QUERIES_AT_ONCE) - low)
                    ids, v = part["vec_id"].to_numpy(), matrix(part["v"], d)
                    if tuple(at[a, :2]) != key:
                        key, have, c_id = tuple(at[a, :2]), [], None
                    if at[a, 2] == 0:
                        have.append((ids, v))
                        continue
                    if not have:
                        continue
                    if c_id is None:
                        c_id, c = np.concatenate([i for i, _ in have]), np.concatenate([w for _, w in have])
                        have = [(c_id, c)]
                    least = np.asarray(part["least"].cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(), dtype=float)
                    owner, found, score, _ = search_cell(ids, v, c_id, c, axes, k, least=least)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    tasks = max(sum(p) for p in placed.values()) * splits
    cells = candidates.unionByName(queries).repartition(tasks, "block", "split").sortWithinPartitions("block", "split", "as_query")
    found = small_batches(cells).mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         case when len(q.e) = 0 or len(c.e) = 0 then 0 else cast(list_dot_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) end as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id is distinct from q.vec_id
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
