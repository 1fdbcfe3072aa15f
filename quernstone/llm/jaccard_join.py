"""N-gram Jaccard join with Bayesian candidate pruning.

A row's shingles are five consecutive words (lower-case letters and digits) as 64-bit hashes.  Rows with one text are one, and texts with one set of
shingles (such as differ in case, marks or white space only) are one node with a weight, so copies of either kind cost nothing further.  Nodes
that agree on four MinHash values of some band are candidates.  A pair's 128 MinHash values are compared sixteen at a time; under a
uniform prior the posterior probability of a similarity of at least the threshold, after m agreements of n, is
P(Binomial(n + 1, threshold) <= m), and the pair is dropped once that falls below the tolerance.  Pairs that remain are
verified exactly on their shingle sets.

No pair is ever a row.  A bucket is worked on in cells of at most two blocks of BLOCK nodes; a cell's task compares in
numpy and returns, for each node, its number of links and one tree edge.  A pair that meets in several buckets counts in the
first one only, and of buckets with the same members one is kept.  Classes are the connected components of all links.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, fresh, slices, small_batches, table
from .decontaminate import normal

WORDS = 5
THRESHOLD = 0.8
HASHES = 128
ROWS = 4
BANDS = HASHES // ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 1024
SEED = 40_961
#: A written table of narrow rows goes to the executors whole up to so many rows; as a hash relation a row takes 120 bytes at most.
BROADCAST_ROWS = 1_000_000
#: The shingle sets of a block of nodes have about so many bytes at most (one set at least).
BLOCK_BYTES = 1 << 25
#: A text with more copies than this meets its class in several tasks.
HOT_COPIES = 8192
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row (not yet distinct), and how many each text has.  Under five words: one, of all words."""
    sym, first, _ = normal(texts)
    space = sym == 32
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    place = np.arange(len(sym)) - np.repeat(np.concatenate(([0], begins[1:])), np.diff(np.concatenate(([0], begins[1:], [len(sym)]))))
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(place.max(initial=0)) + 1, ODD))), dtype=np.uint64)
    value = (sym.astype(np.uint64) + np.uint64(1)) * power[place]
    value[space] = 0
    word = mix(np.add.reduceat(value, begins) + (ends - begins).astype(np.uint64) * ODD)
    doc = np.searchsorted(first, begins, side="right") - 1
    n = np.bincount(doc, minlength=len(texts))
    many = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    start = np.cumsum(n) - n
    at = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    left = np.repeat(start + n, many) - at  # words of the text from here on
    h = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate((word, np.zeros(WORDS, np.uint64)))
    for k in range(WORDS):
        h = h * ODD + np.where(k < left, padded[at + k], np.uint64(0))
    return mix(h), many


@functools.cache
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def signatures(h: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A row of HASHES MinHash values (uint32) for each text that has shingles."""
    many = many[many > 0]
    start = np.cumsum(many) - many
    out = np.empty((len(many), HASHES), dtype=np.uint32)
    a, b = multipliers()
    step = 1 << 15
    cut = [0, *(np.flatnonzero(np.diff(start // step)) + 1).tolist(), len(many)]
    for i, j in zip(cut, cut[1:], strict=False):  # a part fits the cache
        if j > i:
            part, at = h[start[i] : start[j - 1] + many[j - 1]], start[i:j] - start[i]
            for k in range(HASHES):
                out[i:j, k] = np.minimum.reduceat(((part * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


@functools.cache
def least_agreements(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ...: the least m whose posterior reaches the tolerance."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return tuple(out)


def surviving(sig: np.ndarray, mask: np.ndarray, band: int, left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions) that pass the Bayesian pruning and meet in this band first.  same: left and right are one list, each pair once."""
    need = least_agreements(threshold, TOLERANCE)
    found = [[], []]
    bits = ((mask[:, None].astype(np.int64) >> np.arange(BANDS)) & 1).astype(bool)
    for a in range(0, len(left), 128):
        rows = left[a : a + 128]
        agree = np.zeros((len(rows), len(right)), dtype=np.int16)
        for k in range(STEP):
            agree += sig[rows, k][:, None] == sig[right, k][None, :]
        ok = agree >= need[0]
        if same:
            ok &= np.arange(len(right))[None, :] > (a + np.arange(len(rows)))[:, None]
        x, y = np.nonzero(ok)
        n, x, y = agree[x, y].astype(np.int64), rows[x], right[y]
        for s in range(1, len(need)):
            if not len(x):
                break
            cols = slice(s * STEP, (s + 1) * STEP)
            n = n + (sig[x, cols] == sig[y, cols]).sum(axis=1)
            keep = n >= need[s]
            x, y, n = x[keep], y[keep], n[keep]
        for p in range(0, len(x), 1 << 15):
            i, j = x[p : p + (1 << 15)], y[p : p + (1 << 15)]
            meet = (sig[i] == sig[j]).reshape(len(i), BANDS, ROWS).all(axis=2) & bits[i] & bits[j]
            here = meet.argmax(axis=1) == band
            found[0].append(i[here])
            found[1].append(j[here])
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def verified(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of shingle sets have a Jaccard similarity of at least the threshold."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if len(x) <= 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], dtype=np.int64)
    else:  # many pairs of few sets: products of 0/1 matrices over the shingles that more than one set has
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
        shared = n > 1
        place = np.cumsum(shared) - 1
        keep = shared[column]
        owner, column = owner[keep], place[column[keep]]
        by = np.argsort(column, kind="stable")
        owner, column = owner[by], column[by]
        total = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for low in range(0, int(shared.sum()), 2048):
            a, b = np.searchsorted(column, [low, low + 2048])
            m = np.zeros((len(sets), min(2048, int(shared.sum()) - low)), dtype=np.float32)
            m[owner[a:b], column[a:b] - low] = 1
            total += m @ m.T
        both = total[x, y].astype(np.int64)
    return both >= threshold * (size[x] + size[y] - both) - 1e-9


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest position of each position's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text) to (doc_id, digest, digest of the set of shingles, its size, MinHash values); the set and the values null without shingles."""
    for batch, texts in slices(batches, 2):
        h, many = shingles(texts)
        sig = iter(signatures(h, many).view(np.int32).tolist())
        stop = np.cumsum(many)
        found = [np.unique(h[b - n : b]) for b, n in zip(stop.tolist(), many.tolist(), strict=True)]
        sets = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(list(map(len, found)), pa.int64()), pa.array([next(sig) if m else None for m in many.tolist()], pa.list_(pa.int32()))], names=["doc_id", "digest", "set", "size", "sig"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, 1):
        h, many = shingles(texts)
        stop = np.cumsum(many)
        sets = [np.unique(h[b - n : b]).tobytes() for b, n in zip(stop.tolist(), many.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _cell_arrays(t: pa.Table) -> tuple:
    t = t.sort_by("node")
    sig = t["sig"].combine_chunks().flatten().to_numpy().view(np.uint32).reshape(-1, HASHES)
    side = t["side"].to_numpy()
    same = bool(t["lo"][0].as_py() == t["hi"][0].as_py())
    at = np.arange(len(side))
    left, right = (at, at) if same else (at[side == 0], at[side == 1])
    return t, sig, t["mask"].to_numpy(), int(t["band"][0].as_py()), left, right, same


def _candidates(threshold: float):
    def cell(t: pa.Table) -> pa.Table:
        """The nodes of a cell that have a pair left."""
        t, *rest = _cell_arrays(t)
        x, y = surviving(*rest, threshold)
        return t.take(pa.array(np.unique(np.concatenate((x, y))))).select(CELL)

    return cell


def _links(threshold: float):
    def cell(t: pa.Table) -> pa.Table:
        """For each node of a cell: its links there, counted in texts, and the smallest node that it is connected with there."""
        t, *rest = _cell_arrays(t)
        x, y = surviving(*rest, threshold)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in t["shingles"].to_pylist()]
        real = verified(sets, x, y, threshold)
        x, y = x[real], y[real]
        weight = t["weight"].to_numpy()
        n = np.zeros(len(sets), np.int64)
        np.add.at(n, x, weight[y])
        np.add.at(n, y, weight[x])
        node = t["node"].to_numpy()
        root = node[roots(len(sets), x, y)]
        some = n > 0
        return pa.table({"node": node[some], "n": n[some], "root": root[some]})

    return cell


def few(written: DataFrame) -> DataFrame:
    """A written table marked for broadcast where its counted rows stay under 160 MB; else as it is, and both sides are shuffled."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


CELL = ["key", "lo", "hi", "band", "side", "node"]


def components(edges: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(node, root): the smallest node of each node's component, and the kept table that it reads; alternating large and small stars until nothing changes.

    A star's centre is a hash aggregate and a join whose large side can be split, so a hub with many neighbours is no single task.
    """
    e = stage.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state["n"], state["x"]) == seen or not state["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")), e
        seen = (state["n"], state["x"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage.keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = stage.keep(small, "small")
        stage.drop(e, large)
        e = new


def digest(text):
    """Sixteen bytes that stand for a text; null texts are equal to each other and to no other text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("n")).cast("binary"), 256)), 1, 16)


def classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, digest, class_id, n_links, n_copies, kept for each row of (doc_id, text).

    class_id is the smallest doc_id of the class: the texts connected by links, a link being a Jaccard similarity of at least
    `threshold`.  n_links is the number of other texts linked with this row's; n_copies the number of rows with its text; kept is 1
    for the rows of one text of the class whose doc_id is the class_id; where several texts of a class have that id, or none has an
    id, it is the one with the smallest digest.  Null and empty texts, and texts without a letter or digit, have no links; equal ones share a class.
    Rows without id get the class of their text.  Other columns are not read.  Long texts are whole: a cell's task holds two blocks, each of `block`
    nodes and about `block_bytes` of shingle sets at most, and one set at least.
    """
    stage = Stage(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), "text")
    same = stage.keep(  # a row a text
        small_batches(keyed).mapInArrow(_signature_batches, "doc_id long, digest binary, set binary, size long, sig array<int>")
        .groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("set").alias("set"), F.first("size").alias("size"), F.first("sig").alias("sig")),
        "same",
    )
    # a row a set of shingles; it is told by the text that would be kept of its texts
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest"))
    reps = same.where("set is not null").groupBy("set").agg(first.alias("f"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    reps = stage.keep(reps.select("set", F.col("f.rep").alias("rep"), F.col("f.digest").alias("digest"), "weight", "size", "sig").withColumn("node", F.monotonically_increasing_id()), "reps")
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.slice("sig", ROWS * b + 1, ROWS)).alias("key")) for b in range(BANDS)])
    banded = reps.select("node", "size", F.explode(keys).alias("k")).select("node", "size", "k.band", "k.key")
    buckets = banded.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("x2")).where("n > 1")
    blocks = F.least(F.greatest(F.ceil(F.col("n") / block), F.ceil(8 * F.col("size") / block_bytes)), F.col("n")).cast("int")
    buckets = stage.keep(buckets.groupBy("n", "size", "x1", "x2").agg(F.min("key").alias("key")).select("key", blocks.alias("blocks")), "buckets")
    members = banded.join(few(buckets), "key").groupBy("node").agg(F.collect_list(F.struct("key", "band", "blocks")).alias("in"), F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask"))
    # of a bucket with more than `block` nodes, or with long ones, each block meets each block, itself too
    cells = (
        members.select("node", F.explode("in").alias("b")).select("node", "b.*")
        .withColumn("mine", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "band", F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "node")
    )
    schema = "key long, lo int, hi int, band int, side int, node long"
    signed = stage.keep(reps.join(members.select("node", "mask"), "node").select("node", "digest", "rep", "weight", "sig", "mask"), "signed")
    pruned = stage.keep(cells.join(signed.select("node", "sig", "mask"), "node").groupBy("key", "lo", "hi").applyInArrow(_candidates(threshold), schema), "pruned")
    wanted = stage.keep(pruned.select("node").distinct().join(signed.select("node", "digest", "rep"), "node"), "wanted")
    few_wanted = few(wanted.withColumnRenamed("digest", "wanted_digest"))
    texts = keyed.join(few_wanted, (F.col("digest") == F.col("wanted_digest")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    sets = texts.mapInArrow(_set_batches, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    full = stage.keep(sets.join(signed.select("node", "weight", "sig", "mask"), "node"), "sets")
    found = stage.keep(pruned.join(full, "node").groupBy("key", "lo", "hi").applyInArrow(_links(threshold), "node long, n long, root long"), "links")
    stage.drop(full, pruned, wanted, signed, buckets)
    links = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    tree = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), stage)
    tree_table = tree[1]
    tree = links.join(tree[0], "node", "left").select("node", "n_links", F.coalesce("root", "node").alias("root"))
    named = tree.join(reps.select("node", "rep", "digest"), "node")
    chosen = named.groupBy("root").agg(first.alias("first"))
    named = named.join(chosen, "root").select("node", "n_links", "first")
    own = F.struct(F.col("rep").isNull().alias("none"), F.col("rep"), F.col("digest"))
    nodes = reps.select("node", "set", "weight", own.alias("own")).join(named, "node", "left")
    nodes = nodes.select("set", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("first", "own").alias("first"))
    info = same.select("digest", "set", "rep", "n_copies").join(nodes, "set", "left")  # texts without shingles have no node; their nulls meet nothing
    info = info.select("digest", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("first").isNull(), F.col("rep")).otherwise(F.col("first.rep")).alias("class_id"), F.coalesce(F.col("digest") == F.col("first.digest"), F.lit(True)).alias("chosen"))
    info = stage.keep(info, "classes")
    stage.drop(same, reps, found, tree_table)
    # a text with many copies is dealt to several tasks by its rows' ids, and its row of `info` to each of them
    salts = F.ceil(F.col("n_copies") / HOT_COPIES).cast("int")
    hot = stage.keep(info.where(F.col("n_copies") > HOT_COPIES).select("digest", salts.alias("salts")), "hot")
    rows = keyed.select("doc_id", "digest").join(few(hot), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"), F.lit(0)))
    info = info.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return rows.join(info, ["digest", "salt"]).select("doc_id", "digest", "class_id", "n_links", "n_copies", (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("class_id"))).cast("int").alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs of each class, the one that classes() keeps; all columns as they are.

    Of rows with the kept text and the kept id one stays.  Null texts are one class, so one of them stays; empty texts likewise, and equal texts
    without a letter or digit.  A class whose rows have no id keeps one row too.  An empty table stays empty.  Other columns are not read.
    """
    name = fresh(docs, "digest")
    kept = classes(docs).where("kept = 1").select("doc_id", "digest").distinct()
    rows = docs.withColumn(name, digest(F.col("text")))
    rows = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (rows[name] == kept["digest"]), "left_semi")
    return rows.dropDuplicates(["doc_id", name]).drop(name)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """What classes() says, without the digest."""
    return classes(docs, threshold, block).drop("digest")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
