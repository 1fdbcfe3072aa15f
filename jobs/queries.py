"""Both jobs as queries over the test tables: each runs twice into one new folder, and its output is read back after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import inverted as I
from quernstone.plans.catalogue import ANSWER, _terms, _tok
from quernstone.staging import shared_dir

from . import answer_questions, index_documents


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting with what the other two tables say: in how many documents its term is, and the corpus's documents and tokens."""
    at = _folder(spark, "job1")
    s = index_documents.Settings(f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/checkpoint")
    for _ in range(2):
        index_documents.run(spark, s)
    post, terms, sizes = index_documents.tables(spark, s.output)
    df = terms.groupBy("term").agg(F.sum("df").alias("df"))
    size = sizes.agg(F.sum("n").alias("n_documents"), F.sum("total").alias("n_tokens"))  # one row
    return post.join(df, "term").crossJoin(F.broadcast(size)).select("doc_id", "term", "tf", "len", "bucket", "df", "n_documents", "n_tokens")


def job2_answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job2")
    s = answer_questions.Settings(f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{at}/index", f"{at}/answers")
    answer_questions.run(spark, s)
    return answer_questions.run(spark, s)


def queries() -> dict:
    return {f.__name__: f for f in (job1_index_documents, job2_answer_questions)}


def oracle_sql() -> dict:
    intent = " ".join("when regexp_matches(text, '{}') then '{}'".format(pattern.replace("'", "''"), name) for name, pattern in T.INTENTS)
    return {
        "job1_index_documents": f"""with tf as (select doc_id, term, cast(count(*) as integer) as tf from ({_terms('documents', 'doc_id')}) group by all),
          len as (select doc_id, cast(len({_tok('text')}) as bigint) as len from documents),
          size as (select count(*) as n_documents, cast(sum(len) as bigint) as n_tokens from len)
          select doc_id, term, tf, len, cast(('0x' || substr(md5(term), 25, 8))::bigint % {I.BUCKETS} as integer) as bucket, count(*) over (partition by term) as df, n_documents, n_tokens
          from tf join len using (doc_id) cross join size""",
        "job2_answer_questions": f"""with {ANSWER}, named as (
            select query_id, rank, '[' || source || ', ' || doc_id || ']' as name,
              len(list_filter(list_slice(string_split(text, '. '), 1, 4), lambda x: x <> '' and contains(completion, x))) > 0 as used from passage join completion using (query_id)),
          u as (select query_id, string_agg(name, ';' order by rank) filter (used) as names, arg_min(name, rank) as first from named group by query_id),
          many as (select query_id, count(*) as n from passage group by query_id)
          select item_id as query_id, completion as answer, coalesce(names, first) as citations, coalesce(n, 0) as n_passages, completion is null as escalated,
            case {intent} else 'answer' end as intent
          from benchmark left join completion on completion.query_id = item_id left join u on u.query_id = item_id left join many on many.query_id = item_id""",
    }
