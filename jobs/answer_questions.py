"""Answers a table of questions from a table of documents, with citations.

The inverted index of the documents is brought up to date first (jobs.index_documents, with its checkpoint under the index), so a rerun over
grown documents indexes only what has come.  Each question's best passages are found in the index, the answer is taken from their sentences, and a
question without an answer is marked as escalated.  The answers replace those of the last run, partitioned by the question's intent: the same
questions and documents give the same files' rows however often it runs.

    python -m jobs.answer_questions jobs/answer_questions.json questions=/data/questions.parquet
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import answer as A
from quernstone.operators import inverted as I
from quernstone.staging import Stage

from . import index_documents
from .common import log, main


@dataclass(frozen=True)
class Settings:
    documents: str
    questions: str
    index: str
    output: str
    id_column: str = "doc_id"
    text_column: str = "text"
    name_column: str = "source"
    question_id: str = "item_id"
    question_text: str = "text"
    passages: int = 4


ANSWERS = "query_id long, answer string, citations string, n_passages long, escalated boolean, intent string"


def run(spark: SparkSession, s: Settings) -> DataFrame:
    """Writes the answers and gives them back as they were written."""
    index_documents.run(spark, index_documents.Settings(s.documents, s.index, f"{s.index}/checkpoint", s.id_column, s.text_column))
    post, terms, sizes = index_documents.tables(spark, s.index)
    asked = spark.read.parquet(s.questions).select(F.col(s.question_id).cast("string").alias("query_id"), F.coalesce(F.col(s.question_text), F.lit("")).alias("question"))
    texts = spark.read.parquet(s.documents).select(F.col(s.id_column).cast("string").alias("id"), F.col(s.text_column).alias("text"), T.citation(F.col(s.name_column), F.col(s.id_column).cast("string")).alias("citation"))
    found = I.search(post, terms, sizes, asked, s.passages).drop("tie").join(asked, "query_id").join(texts, "id")
    stage = Stage(spark)
    passages = stage.keep(found, "passages")  # a few rows a question, read three times
    said = A.extract_answers(passages)
    cited = A.cited(passages, said).select("query_id", F.array_join("citations", ";").alias("citations"))
    many = passages.groupBy("query_id").agg(F.count("*").alias("n_passages"))
    out = asked.join(said.select("query_id", "completion"), "query_id", "left").join(cited, "query_id", "left").join(many, "query_id", "left").select(
        F.col("query_id").cast("long").alias("query_id"), F.col("completion").alias("answer"), F.when(F.col("completion").isNotNull(), F.col("citations")).alias("citations"),
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.col("completion").isNull().alias("escalated"), T.intent(F.col("question")).alias("intent"),
    )
    out.write.mode("overwrite").partitionBy("intent").parquet(s.output)
    stage.drop(passages)
    written = spark.read.schema(ANSWERS).parquet(s.output)
    log.info("answered %d of %d questions from %s; answers by intent are at %s", written.where("not escalated").count(), written.count(), s.documents, s.output)
    return written


if __name__ == "__main__":
    main("answer_questions", Settings, run)
