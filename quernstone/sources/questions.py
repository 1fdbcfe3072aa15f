"""Labelled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.evaluate import DatasetError, named

SCHEMA = "questions array<struct<id:string,question:string,relevant:array<string>,note:string>>"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, relevant, note, answerable) of a JSON file {"questions": [...]}; a repeated id is a DatasetError."""
    rows = spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.explode("questions").alias("q")).select("q.*")
    out = rows.select(F.col("id").alias("query_id"), "question", F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"), F.coalesce("note", F.lit("")).alias("note"))
    twice = out.groupBy("query_id").count().where("count > 1").select("query_id")
    if n := twice.count():
        raise DatasetError(named(f"{n} ids that stand more than once", twice.orderBy("query_id"), n))
    return out.withColumn("answerable", F.size("relevant") > 0)
