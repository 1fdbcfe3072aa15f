"""A corpus pipeline: documents in, token digests of the clean ones out.

Each stage takes the rows that the stage before it kept, as rows of documents, and its decisions take effect.  Results are written
as Parquet into the folder that all executors share and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.bpe import bpe_encode, tokenizer_path
from quernstone.llm.common import Stage, table
from quernstone.llm.decontaminate import without_leaks
from quernstone.llm.jaccard_join import one_of_each
from quernstone.llm.pii import redact
from quernstone.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.

    Null and empty texts are scored as empty; equal texts share their fate; without labelled rows of both classes all stay.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of exact copies and near duplicates the document with the smallest id stays.

    Null texts are one class, so one of them stays, and so are empty ones.  Of equal rows one stays; a class without any id keeps one row.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.  Null and empty texts stay; an empty benchmark takes nothing."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text.  Null and empty texts stay as they are; no row goes."""
    out = redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row a row.  Null and empty texts have no tokens; ids may be null or repeated."""
    return bpe_encode(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]
#: SQL can express none of the stages as a whole; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's table is deleted once the next one's is written; empty tables go through as such."""
    stage, docs, before = Stage(spark), table(spark, sf_dir, "documents"), None
    for name, f in STAGES[:-1]:
        docs = stage.keep(f(spark, docs, sf_dir), name)
        if before is not None:
            stage.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
