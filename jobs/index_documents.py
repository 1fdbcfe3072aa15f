"""Keeps an inverted index up to date: takes the files that have come since the last run and adds their postings.

A file stream with availableNow reads a folder (or file) of documents; its checkpoint is the mark of what has been taken.  Each batch is written to
directories of its own number, replaced whole if the batch is run again after a failure, so a rerun gives the same tables.
Tables under `output`: `postings/batch=*/bucket=*`, `terms/batch=*/bucket=*` and `sizes/batch=*` (see quernstone.operators.inverted).

    python -m jobs.index_documents jobs/index_documents.json documents=/data/documents output=/data/index
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quernstone.operators import inverted as I

from .common import log, main

POSTINGS = "doc_id {id}, term string, tf int, len long, shard int, batch int, bucket int"
TERMS = "term string, df long, batch int, bucket int"
SIZES = "n long, total long, batch int"


@dataclass(frozen=True)
class Settings:
    """documents: a folder of Parquet files to which files are added, or one file; files_in_batch bounds what a batch takes."""

    documents: str
    output: str
    checkpoint: str
    id_column: str = "doc_id"
    text_column: str = "text"
    id_type: str = "long"
    files_in_batch: int = 1000


def run(spark: SparkSession, s: Settings) -> int:
    """Takes what is new; how many documents that were."""
    path = s.documents.rstrip("/")
    one = f"{path[:-1]}[{path[-1]}]"  # a pattern that only this path matches: a stream reads a single file by a pattern only
    source = spark.readStream.schema(f"`{s.id_column}` {s.id_type}, `{s.text_column}` string").option("maxFilesPerTrigger", s.files_in_batch).parquet(one)
    taken = []

    def add(batch: DataFrame, number: int) -> None:
        held = batch.sparkSession
        docs = batch.select(batch[s.id_column].alias("doc_id"), batch[s.text_column].alias("text"))
        n = docs.count()
        rows = I.laid_out(I.postings(docs, n))
        at = f"{s.output}/postings/batch={number}"
        rows.write.mode("overwrite").partitionBy("bucket").parquet(at)
        schema = POSTINGS.format(id=s.id_type).replace(", batch int", "")
        written = held.read.schema(schema).parquet(at)
        I.term_counts(written).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{s.output}/terms/batch={number}")
        total = I.tokens(written)
        held.createDataFrame([(n, total)], "n long, total long").coalesce(1).write.mode("overwrite").parquet(f"{s.output}/sizes/batch={number}")
        taken.append(n)
        log.info("batch %d: read %d documents with %d tokens from %s, wrote their postings to %s", number, n, total, s.documents, at)

    stream = source.writeStream.foreachBatch(add).option("checkpointLocation", s.checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("took %d new documents in %d batches; the index is at %s", sum(taken), len(taken), s.output)
    return sum(taken)


def tables(spark: SparkSession, output: str, id_type: str = "long") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, term counts and sizes of all batches."""
    return (
        spark.read.schema(POSTINGS.format(id=id_type)).parquet(f"{output}/postings"), spark.read.schema(TERMS).parquet(f"{output}/terms"), spark.read.schema(SIZES).parquet(f"{output}/sizes"),
    )


if __name__ == "__main__":
    main("index_documents", Settings, run)
