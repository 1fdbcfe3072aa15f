"""Dense, lexical and fused top-k of a batch of questions over an index.

The questions are a stated query set.  They are taken in blocks of bounded size to where the index rows are; a task scores its rows
against a block on Arrow's own buffers and gives back only its own k best for each question.  So what is shuffled is k rows for each
question and task, however large the index is, and the index itself never moves.  With more than one block each block's results are
written before the next block is fetched, so the driver never holds more than one.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.config import RetrievalConfig
from quernstone.functions import text as T
from quernstone.staging import Stage

from .arrow import small_batches

#: Fixed values of the lexical score.
K1, B = 1.5, 0.75
#: Scores are ranked as rounded to so many places, so that the order of a sum can't decide between equal ones.
PLACES = 9
QUESTIONS_IN_BLOCK = 2048
#: A task scores so many pairs of rows and questions at once.
PAIRS = 1 << 19


def with_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `terms`, `tfs` (a forward index: distinct stems in order and their counts) and `len` (all stems); no shuffle.

    The sorted stems of a row are cut where neighbours differ.  sort_array compares them natively, array_sort by an interpreted function.
    """
    kept = [F.col(c) for c in df.columns if c not in ("terms", "tfs", "len")]
    n, at = F.size("__stems"), lambda i: F.get(F.col("__stems"), i)
    rows = df.withColumn("__stems", F.sort_array(T.lexical_tokens(F.coalesce(F.col(text), F.lit("")))))
    rows = rows.withColumn("__ends", F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == n) | (at(i) != at(i - 1))))
    tfs = F.transform("__ends", lambda e, i: (e - F.coalesce(F.get(F.col("__ends"), i - 1), F.lit(0))).cast("int"))
    return rows.select(*kept, F.transform("__ends", lambda e: at(e - 1)).alias("terms"), tfs.alias("tfs"), n.cast("long").alias("len"))


class Best:
    """The k best rows of each question seen so far: larger score, then smaller tie."""

    def __init__(self, questions: int, k: int, floor: float):
        self.k, self.floor = k, floor
        self.least = np.full(questions, floor)
        self.q, self.s = np.zeros(0, np.int64), np.zeros(0)
        self.ids, self.ties = np.zeros(0, object), np.zeros(0, object)

    def add(self, scores: np.ndarray, ids: pa.Array, ties: pa.Array) -> None:
        """Scores of some rows (questions by rows); only those over the floor count."""
        scores = np.round(scores, PLACES)
        n, low = scores.shape[1], self.least
        if n > self.k:  # what is under these rows' own k-th best can't stay
            low = np.maximum(low, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        q, row = np.nonzero((scores >= low[:, None]) & (scores > self.floor))
        self.q, self.s = np.concatenate((self.q, q)), np.concatenate((self.s, scores[q, row]))
        take = pa.array(row)
        self.ids = np.concatenate((self.ids, np.array(ids.take(take).to_pylist(), dtype=object)))
        self.ties = np.concatenate((self.ties, np.array(ties.take(take).to_pylist(), dtype=object)))
        tie = np.unique(self.ties, return_inverse=True)[1] if len(self.ties) else np.zeros(0, np.int64)
        order = np.lexsort((tie, -self.s, self.q))
        o = self.q[order]
        first = np.maximum.accumulate(np.where(np.concatenate(([True], o[1:] != o[:-1])), np.arange(len(o)), 0)) if len(o) else o
        keep = order[np.arange(len(o)) - first < self.k]
        self.q, self.s, self.ids, self.ties = self.q[keep], self.s[keep], self.ids[keep], self.ties[keep]
        many, worst = np.bincount(self.q, minlength=len(self.least)), np.full(len(self.least), np.inf)
        np.minimum.at(worst, self.q, self.s)
        self.least = np.where(many >= self.k, worst, self.floor)


def scored(index: DataFrame, columns: list[str], tie: str, names: list[str], k: int, floor: float, score: Callable[[list], np.ndarray]) -> DataFrame:
    """(query_id, id, tie, score): each task's k best for each question.  score(Arrow columns) gives questions by rows."""
    schema = f"query_id string, id string, tie {dict(index.dtypes)[tie]}, score double"
    step = max(1, PAIRS // max(1, len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(len(names), k, floor), None
        for whole in batches:
            kind = whole.column(1).type
            for low in range(0, whole.num_rows if names else 0, step):
                b = whole.slice(low, step)
                best.add(score(b.columns[2:]), b.column(0), b.column(1))
        pa.default_memory_pool().release_unused()  # the worker process lives on
        if len(best.q):
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in best.q.tolist()]), pa.array(best.ids.tolist(), pa.string()), pa.array(best.ties.tolist(), kind), pa.array(best.s)], names=["query_id", "id", "tie", "score"])

    return small_batches(index.select(F.col("id").cast("string").alias("id"), F.col(tie).alias("tie"), *columns)).mapInArrow(run, schema)


def ranked(found: DataFrame, k: int, method: str) -> DataFrame:
    """The k best of each question over all tasks: (query_id, id, score, method, rank, tie)."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "tie")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", F.lit(method).alias("method"), "rank", "tie")


def by_blocks(questions: DataFrame, columns: list[str | Column], search: Callable[[list], DataFrame]) -> DataFrame:
    """What search(rows of a block) gives for all blocks of questions (query_id and columns); one block is on the driver at a time."""
    n = max(1, -(-questions.count() // QUESTIONS_IN_BLOCK))
    part = F.pmod(F.xxhash64("query_id"), F.lit(n))
    fetch = lambda i: questions.where(part == i).select(F.col("query_id").cast("string").alias("query_id"), *columns).orderBy("query_id").collect()
    if n == 1:
        return search(fetch(0))
    stage, schema = Stage(questions.sparkSession), None
    for i in range(n):
        found = search(fetch(i))
        schema = found.schema
        stage.append(found, "found")
    return stage.read("found", schema)


def dense(index: DataFrame, questions: DataFrame, k: int, tie: str = "tie") -> DataFrame:
    """Exact cosine of `vector`.  Every row with a vector is a candidate, also at score 0; a row without length has score 0 and a question without length no results."""
    rows = index.where(F.col("vector").isNotNull())

    def search(block: list) -> DataFrame:
        named = [(r["query_id"], v) for r in block if (v := np.asarray(r["vector"], dtype=float)).any()]
        q = np.array([v / np.linalg.norm(v) for _, v in named])

        def score(columns: list) -> np.ndarray:
            v = columns[0].flatten().to_numpy(zero_copy_only=False).reshape(len(columns[0]), -1).astype(float)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            return q @ (v / np.where(n > 0, n, 1)).T

        return scored(rows, ["vector"], tie, [n for n, _ in named], k, -math.inf, score)

    return ranked(by_blocks(questions, ["vector"], search), k, "dense")


def document_frequency(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many rows each of some terms stands; partial counts are combined before the shuffle."""
    each = index.select(F.explode("terms").alias("term")).where(F.col("term").isin(terms) if terms else F.lit(False))
    return {r["term"]: r["n"] for r in each.groupBy("term").agg(F.count("*").alias("n")).collect()}


def lexical(index: DataFrame, questions: DataFrame, k: int, tie: str = "tie") -> DataFrame:
    """BM25 over `terms`, `tfs` and `len`.  A term counts as often as the question has it; only scores over 0 are results."""
    size = index.agg(F.count("*").alias("n"), F.sum("len").alias("total")).first()
    n, mean = size["n"] or 0, (size["total"] or 0) / max(size["n"] or 0, 1)
    asked = with_terms(questions.select("query_id", "question"), "question")

    def search(block: list) -> DataFrame:
        vocab = sorted({t for r in block for t in r["terms"]})
        df = document_frequency(index, vocab)
        known = [t for t in vocab if t in df]
        place = {t: i for i, t in enumerate(known)}
        weights = sorted((place[t], q, many * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) for q, r in enumerate(block) for t, many in zip(r["terms"], r["tfs"], strict=True) if t in place)
        of_term, question, weight = (np.array(x) for x in zip(*weights, strict=True)) if weights else (np.zeros(0, np.int64),) * 3
        first = np.searchsorted(of_term, np.arange(len(known) + 1))  # where the questions of each term begin
        total, listed = len(block), pa.array(known, pa.string())

        def score(columns: list) -> np.ndarray:
            terms, tfs, lens = columns
            rows = len(terms)
            at = pc.index_in(terms.flatten(), value_set=listed)
            row = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            at, row = at.drop_null().to_numpy().astype(np.int64), row[hit]
            tf = tfs.flatten().to_numpy(zero_copy_only=False)[hit].astype(float)
            room = K1 * (1 - B + B * np.maximum(pc.fill_null(lens, 1).to_numpy(zero_copy_only=False).astype(float), 1) / (mean or 1))
            part = tf * (K1 + 1) / (tf + room[row])
            many = first[at + 1] - first[at]
            of = np.repeat(first[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out = np.bincount(question[of] * rows + np.repeat(row, many), weights=np.repeat(part, many) * weight[of], minlength=rows * total)
            return out.reshape(total, rows)

        return scored(index, ["terms", "tfs", "len"], tie, [r["query_id"] for r in block] if weights else [], k, 0.0, score)

    return ranked(by_blocks(asked, ["terms", "tfs"], search), k, "lexical")


def fuse(lists: list[DataFrame], weights: list[float], k: int = 60, limit: int = 6, method: str = "hybrid") -> DataFrame:
    """Reciprocal rank fusion; ties go to what was seen first: by list, then by rank in it."""
    if len(lists) != len(weights):
        raise ValueError("a weight for each list is needed")
    tagged = [x.select("query_id", "id", (F.lit(float(w)) / (k + F.col("rank"))).alias("s"), F.struct(F.lit(i).alias("list"), F.col("rank")).alias("seen")) for i, (x, w) in enumerate(zip(lists, weights, strict=True))]
    # dealt anew, as the lists' own dealings may differ in number once they are coalesced at run time
    both = functools.reduce(DataFrame.unionByName, tagged).repartition("query_id").groupBy("query_id", "id").agg(F.round(F.sum("s"), 12).alias("score"), F.min("seen").alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seen")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "id", "score", F.lit(method).alias("method"), "rank")


def hybrid(index: DataFrame, questions: DataFrame, config: RetrievalConfig | None = None, limit: int | None = None) -> DataFrame:
    """The dense and the lexical lists fused; at most dense_k + lexical_k results whatever the limit."""
    c = config or RetrievalConfig()
    return fuse([dense(index, questions, c.dense_k), lexical(index, questions, c.lexical_k)], [c.dense_weight, c.lexical_weight], c.rrf_k, limit or c.final_k)
