"""what job1_index_documents does once a batch, and natively."""

from pyspark.sql import functions as F

from jobs import index_documents
from quernstone.functions import text as T
from quernstone.operators import search


def test_a_batch_splits_its_texts_once(spark, tmp_path, monkeypatch):
    rows = [(1, "The cats, the cat's mat. THE END"), (2, ""), (3, None), (4, "é ü"), (1, "walking walked walks"), (None, "no id 7 7 7")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents"))
    calls, real = [], T.tokens
    monkeypatch.setattr(T, "tokens", lambda c: calls.append(1) or real(c))
    s = index_documents.Settings(str(tmp_path / "documents"), str(tmp_path / "index"), str(tmp_path / "checkpoint"))
    assert index_documents.run(spark, s) == 6 and len(calls) == 1
    post, _, sizes = index_documents.tables(spark, s.output)
    assert [tuple(r) for r in sizes.select("n", "total").collect()] == [(6, 7 + 3 + 5)]
    assert {(r["doc_id"], r["term"], r["tf"], r["len"]) for r in post.collect()} >= {(1, "the", 3, 7), (1, "walk", 3, 3), (None, "7", 3, 5)}


def test_a_batch_without_a_token(spark, tmp_path):
    spark.createDataFrame([(1, ""), (2, None), (3, "!?")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents"))
    s = index_documents.Settings(str(tmp_path / "documents"), str(tmp_path / "index"), str(tmp_path / "checkpoint"))
    assert index_documents.run(spark, s) == 3
    assert [tuple(r) for r in index_documents.tables(spark, s.output)[2].select("n", "total").collect()] == [(3, 0)]


def test_buckets_read_one_word_of_the_digest_and_stems_sort_natively(spark):
    df = spark.createDataFrame([("b a b",)], "text string")
    said = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    plan = said(df.select(T.bucket(F.col("text"), 16)))
    assert plan.count("conv(substring(md5(cast(") == 1
    assert "sort_array(" in said(search.with_terms(df)) and "array_sort(" not in said(search.with_terms(df))
