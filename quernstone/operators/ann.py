"""Approximate cosine search: inverted lists of cells, product-quantised residuals, and an exact second look at the best.

Vectors are dealt to the cells of a k-means clustering.  What a vector differs from its cell's centre by is cut into pieces, each told by the
nearest of CODES learnt pieces, a byte a piece.  A question probes its nearest cells; there a vector's score is estimated by one table look-up a piece, the
best `keep` of a question get their exact cosine, and the k best of those are the result.  Clustering and pieces are learnt from a bounded sample,
every vector is indexed, and probing all cells and keeping all rows is the exact search.  Measured recall belongs to the data: see recall().

A cell with many vectors, copies of one for instance, is split into parts of bounded size, and a part's questions come to it; nothing whole is on the driver
but the cells' centres, the learnt pieces and the cells' sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.staging import Stage

from . import search as S

#: Bounds: vectors that are learnt from, codes of a piece, rows of a part, pairs scored at once.
SAMPLE, CODES, PART_ROWS, PAIRS = 16_384, 256, 65_536, 1 << 21
ROUNDS = 12


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors as rows; one without length stays as it is."""
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float32)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def nearest(x: np.ndarray, centres: np.ndarray, many: int = 1) -> np.ndarray:
    """The places of each row's `many` nearest centres, the nearest first."""
    away = (centres**2).sum(1) / 2 - x @ centres.T
    if many == 1:
        return away.argmin(1)[:, None]
    some = np.argpartition(away, min(many, away.shape[1]) - 1, axis=1)[:, :many]
    return np.take_along_axis(some, np.take_along_axis(away, some, 1).argsort(1, kind="stable"), 1)


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k centres of some rows; a centre that loses its rows goes to the row that is worst off."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)[:, 0]
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres, dtype=np.float64)
        np.add.at(sums, own, x)
        centres = (sums / np.maximum(size, 1)[:, None]).astype(np.float32)
        empty = np.flatnonzero(size == 0)
        if len(empty):
            worst = ((x - centres[own]) ** 2).sum(1).argsort()[::-1][: len(empty)]
            centres[empty] = x[worst]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """Cells' centres (cells by width), and for each piece of a vector its place and its learnt pieces."""

    centres: np.ndarray
    cuts: tuple[int, ...]
    pieces: tuple[np.ndarray, ...]

    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.cuts, self.cuts[1:], strict=False))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell and the codes of its pieces."""
        cell = nearest(x, self.centres)[:, 0]
        rest = x - self.centres[cell]
        return cell, np.column_stack([nearest(rest[:, a:b], p)[:, 0] for (a, b), p in zip(self.spans(), self.pieces, strict=True)]).astype(np.uint8)

    def estimate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Estimated cosines of questions (rows of q) and a cell's vectors."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for m, ((a, b), p) in enumerate(zip(self.spans(), self.pieces, strict=True)):
            out += (q[:, a:b] @ p.T)[:, codes[:, m]]
        return out


def sampled(vectors: DataFrame, rows: int) -> DataFrame:
    """About `rows` vectors at most, the same ones whatever the partitioning."""
    n = vectors.count()
    u = F.xxhash64(F.lit(3), "id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return vectors.where(u * n < rows).select("id", "vector")


def learn(vectors: DataFrame, cells: int, pieces: int, seed: int = 1, sample: int = SAMPLE) -> Quantiser:
    """A quantiser from a bounded sample of (id, vector): the cells by Spark's k-means, each piece's codes by a task of its own."""
    stage = Stage(vectors.sparkSession)
    some = stage.keep(sampled(vectors, sample).mapInArrow(_units, "id string, vector array<float>"), "sample")
    model = KMeans(k=cells, seed=seed, maxIter=ROUNDS, featuresCol="f").fit(some.select(array_to_vector(F.col("vector").cast("array<double>")).alias("f")))
    centres = np.array(model.clusterCenters(), dtype=np.float32)
    cuts = tuple(int(c) for c in np.linspace(0, centres.shape[1], min(pieces, centres.shape[1]) + 1).round())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            rest = x - centres[nearest(x, centres)[:, 0]]
            for m, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(x), pa.int32()), pa.array(list(rest[:, a:b]), pa.list_(pa.float32()))], names=["piece", "x"])

    def codes(t: pa.Table) -> pa.Table:
        x = t["x"].combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        found = lloyd(x, CODES, seed)
        return pa.table({"piece": pa.array([t["piece"][0].as_py()] * len(found), pa.int32()), "code": pa.array(range(len(found)), pa.int32()), "x": pa.array(list(found), pa.list_(pa.float32()))})

    rows = some.mapInArrow(cut, "piece int, x array<float>").groupBy("piece").applyInArrow(codes, "piece int, code int, x array<float>").orderBy("piece", "code").collect()  # CODES a piece at most
    stage.drop(some)
    return Quantiser(centres, cuts, tuple(np.array([r["x"] for r in rows if r["piece"] == m], dtype=np.float32) for m in range(len(cuts) - 1)))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(list(matrix(batch.column(1))), pa.list_(pa.float32()))], names=["id", "vector"])


INDEX = "id string, cell int, part int, code binary"


class CellIndex:
    """An index of (id, vector) rows in a table at `path`; rows without a vector are not in it, ids are expected once each."""

    def __init__(self, spark: SparkSession, path: str, quantiser: Quantiser):
        self.spark, self.path, self.quantiser = spark, path, quantiser

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, pieces: int = 16, seed: int = 1) -> CellIndex:
        """Learns and writes an index; cells: about the root of the number of vectors where it isn't given."""
        held = vectors.where(F.col("vector").isNotNull()).select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        n = held.count()
        index = cls(vectors.sparkSession, path, learn(held, cells or max(2, min(65_536, round(math.sqrt(max(n, 1))))), pieces, seed))
        index.add(held)
        return index

    def add(self, vectors: DataFrame) -> None:
        """Appends rows; the quantiser stays as it is."""
        quantiser = self.quantiser

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 4096):
                    b = batch.slice(low, 4096)
                    cell, code = quantiser.encode(matrix(b.column(1)))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "cell", "code"])

        rows = vectors.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector")).mapInArrow(encode, "id string, cell int, code binary")
        stage = Stage(self.spark)
        coded = stage.keep(rows, "coded")
        sizes = F.broadcast(coded.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")))  # a row a cell
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        coded.join(sizes, "cell").select("id", "cell", part.alias("part"), "code").sortWithinPartitions("cell", "part").write.mode("append").parquet(self.path)
        stage.drop(coded)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(self.path)

    def candidates(self, questions: DataFrame, probes: int, keep: int) -> DataFrame:
        """(query_id, id): the rows of each question (query_id, vector) with the `keep` best estimates in its `probes` nearest cells."""
        quantiser, cells = self.quantiser, len(self.quantiser.centres)
        asked = questions.where(F.exists("vector", lambda v: v != 0)).select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<float>").alias("vector"))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = nearest(matrix(batch.column(1)), quantiser.centres, min(probes, cells))
                    at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel(), pa.int32())], names=["query_id", "vector", "cell"])

        rows = self.rows()
        parts = F.broadcast(self.rows().select("cell", "part").distinct())  # a row a part
        sent = asked.mapInArrow(probe, "query_id string, vector array<float>, cell int").join(parts, "cell")

        def estimated(held: pa.Table, came: pa.Table) -> pa.Table:
            names, ids, s = [], [], []
            if held.num_rows and came.num_rows:
                cell = held["cell"][0].as_py()
                codes = np.frombuffer(b"".join(held["code"].to_pylist()), dtype=np.uint8).reshape(held.num_rows, -1)
                q = matrix(came["vector"].combine_chunks())
                step = max(1, PAIRS // held.num_rows)
                for low in range(0, len(q), step):
                    e = quantiser.estimate(q[low : low + step], cell, codes)
                    top = np.argpartition(-e, min(keep, e.shape[1]) - 1, axis=1)[:, :keep]
                    names.append(np.repeat(np.arange(low, low + len(e)), top.shape[1]))
                    ids.append(top.ravel())
                    s.append(np.take_along_axis(e, top, 1).ravel())
            at, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (names, ids))
            score = np.concatenate(s).astype(float) if s else np.zeros(0)
            return pa.table({"query_id": came["query_id"].take(pa.array(at)).cast(pa.string()), "id": held["id"].take(pa.array(row)).cast(pa.string()), "estimate": pa.array(score, pa.float64())})

        found = rows.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part")).applyInArrow(estimated, "query_id string, id string, estimate double")
        order = Window.partitionBy("query_id").orderBy(F.col("estimate").desc(), "id")
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).select("query_id", "id")

    def search(self, vectors: DataFrame, questions: DataFrame, k: int, probes: int = 8, keep: int = 100, tie: str = "tie") -> DataFrame:
        """query_id, id, score, method, rank, tie as search.dense gives them, of the candidates' exact cosines; vectors: (id, tie, vector)."""
        some = self.candidates(questions, probes, keep)
        exact = some.join(vectors.select(F.col("id").cast("string").alias("id"), F.col(tie).alias("tie"), "vector"), "id").join(questions.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").alias("asked")), "query_id")
        total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
        norm = F.sqrt(total("vector", "vector")) * F.sqrt(total("asked", "asked"))
        score = F.when(norm > 0, total("vector", "asked") / norm).otherwise(0.0)
        return S.ranked(exact.select("query_id", "id", "tie", F.round(score, S.PLACES).alias("score")), k, "dense")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: questions, results of the exact search, how many of those were found, and their share (1 without any)."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("questions"), F.count("*").alias("wanted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))
