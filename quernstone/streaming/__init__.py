"""Watching a folder: new files are ingested as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.plans.engine import Engine

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, engine: Engine, folder: str, checkpoint: str, once: bool = True):
    """A query that ingests each batch of new files of a folder; once: only what is there now.  A batch that is run again replaces itself."""
    files = spark.readStream.schema(BINARY).format("binaryFile").load(folder)

    def put(batch: DataFrame, _: int) -> None:
        engine.ingest_documents(engine.extracted(batch)).count()

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
