"""An inverted index in plain Parquet tables, added to batch by batch and searched without a pass over the corpus.

Three tables: `postings` (a row a document and term: tf and the document's length), `terms` (how many of a batch's documents hold a term) and `sizes` (a
batch's number of documents and of tokens).  The last two are what BM25 needs of the whole corpus; as sums over batches they are exact
without a recount.  Postings are split into directories by a bucket of the term and sorted by term inside, so a search opens the buckets of its
questions' terms only and skips row groups of others.  Documents are dealt to shards of bounded size within their batch; a shard's matching
postings meet in one task, which scores them against all questions at once and gives back its own k best of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T

from . import search as S

BUCKETS = 16
DOCUMENTS_IN_SHARD = 2048
#: Up to so many terms of a block of questions become a filter that reaches the files; more are joined.
TERMS_IN_FILTER = 4096


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return T.bucket(term, buckets).cast("int")


def postings(documents: DataFrame, n_documents: int, buckets: int = BUCKETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf, len, shard, bucket) of each row's distinct terms; null and empty texts have none.  Rows that share an id are rows of their own in one shard."""
    shards = max(1, -(-n_documents // DOCUMENTS_IN_SHARD))
    rows = S.with_terms(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).drop("text")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    each = rows.select("doc_id", "len", "shard", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    term = F.col("p.terms")
    return each.select("doc_id", term.alias("term"), F.col("p.tfs").alias("tf"), "len", "shard", bucket_of(term, buckets).alias("bucket"))


def laid_out(rows: DataFrame) -> DataFrame:
    """Postings dealt by bucket, large ones to several tasks at run time, and sorted so that equal terms are neighbours in a file."""
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")


def term_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "bucket").agg(F.count("*").alias("df"))


def tokens(rows: DataFrame) -> int:
    """All tokens of the documents whose postings these are, so that no text is split twice."""
    return rows.agg(F.sum("tf")).first()[0] or 0


def matching(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Rows of these terms: by a filter on bucket and term where they are few, else by a join with a table of them that is sent along."""
    spark = rows.sparkSession
    if len(vocabulary) <= TERMS_IN_FILTER:
        asked = spark.createDataFrame([(t,) for t in vocabulary], "term string").select(bucket_of(F.col("term")).alias("b")).distinct()
        return rows.where(F.col("bucket").isin([r["b"] for r in asked.collect()]) & F.col("term").isin(vocabulary))
    return rows.join(F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "term string")), "term", "left_semi")


def search(post: DataFrame, terms: DataFrame, size: DataFrame, questions: DataFrame, k: int, shard: list[str] | None = None) -> DataFrame:
    """BM25 of (query_id, question): query_id, id, score, method, rank, tie, as search.lexical gives them with the id as the tie.

    Rows without an id count in the statistics and are no results; rows of a batch that share one are scored as one document.

    shard: the columns that name a shard, by default those among batch and shard that the postings have.
    """
    row = size.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, mean = row["n"] or 0, (row["total"] or 0) / max(row["n"] or 0, 1)
    asked = S.with_terms(questions.select("query_id", "question"), "question")
    by = shard or [c for c in ("batch", "shard") if c in post.columns]
    schema = f"query_id string, id string, tie {dict(post.dtypes)['doc_id']}, score double"

    def one_block(block: list) -> DataFrame:
        vocabulary = sorted({t for r in block for t in r["terms"]})
        df = {r["term"]: r["df"] for r in matching(terms, vocabulary).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        known = [t for t in vocabulary if t in df]
        place = {t: i for i, t in enumerate(known)}
        weights = sorted((place[t], q, many * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) for q, r in enumerate(block) for t, many in zip(r["terms"], r["tfs"], strict=True) if t in place)
        names = [r["query_id"] for r in block]
        found = matching(post, known).where(F.col("doc_id").isNotNull()).select(*by, "term", "doc_id", "tf", "len")
        return found.groupBy(*by).applyInArrow(scorer(names, known, weights, mean, k), schema)

    return S.ranked(S.by_blocks(asked, ["terms", "tfs"], one_block), k, "lexical")


def scorer(names: list[str], known: list[str], weights: list[tuple[int, int, float]], mean: float, k: int):
    """A function of a shard's matching postings: its k best documents of each question."""
    of_term, question, weight = (np.array(x) for x in zip(*weights, strict=True)) if weights else (np.zeros(0, np.int64),) * 3
    first = np.searchsorted(of_term, np.arange(len(known) + 1))
    step = max(1, S.PAIRS // max(1, len(names)))

    def score(t: pa.Table) -> pa.Table:
        best = S.Best(len(names), k, 0.0)
        ids = t["doc_id"].combine_chunks().dictionary_encode()
        doc = ids.indices.to_numpy().astype(np.int64)
        term = pc.index_in(t["term"], value_set=pa.array(known, pa.string())).to_numpy().astype(np.int64)
        tf, long = t["tf"].to_numpy().astype(float), t["len"].to_numpy().astype(float)
        part = tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * np.maximum(long, 1) / (mean or 1)))
        order = np.lexsort((term, doc))  # sums go in one order, whatever order the rows came in
        doc, term, part = doc[order], term[order], part[order]
        for low in range(0, len(ids.dictionary), step):
            a, b = np.searchsorted(doc, (low, low + step))
            rows = min(step, len(ids.dictionary) - low)
            at = term[a:b]
            many = first[at + 1] - first[at]
            of = np.repeat(first[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            cell = question[of] * rows + np.repeat(doc[a:b] - low, many)
            sums = np.bincount(cell, weights=np.repeat(part[a:b], many) * weight[of], minlength=rows * len(names)).reshape(len(names), rows)
            held = ids.dictionary.slice(low, rows)
            best.add(sums, held.cast(pa.string()), held)
        return pa.table({"query_id": pa.array([names[q] for q in best.q.tolist()], pa.string()), "id": pa.array(best.ids.tolist(), pa.string()), "tie": pa.array(best.ties.tolist(), ids.type.value_type), "score": pa.array(best.s, pa.float64())})

    return score


