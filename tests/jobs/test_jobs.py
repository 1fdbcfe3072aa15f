"""Both jobs on copies of the small tables: growing input, repeated runs, failed batches, and the index against a pass over the corpus."""

import json
import math
import os
import re
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobs import answer_questions, common, index_documents
from quernstone.operators import inverted, search

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def growing(spark, tmp_path):
    """A folder to which parts of the documents are added, and where a job may write."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")

    def add(k, of=3):
        docs.where(F.col("doc_id") % of == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "documents"))

    return tmp_path, add


def settings(at, **more):
    return index_documents.Settings(str(at / "documents"), str(at / "index"), str(at / "checkpoint"), **more)


def rows(spark, at):
    post, terms, sizes = index_documents.tables(spark, str(at / "index"))
    df = {r["term"]: r["df"] for r in terms.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    size = sizes.agg(F.sum("n"), F.sum("total")).first()
    return Counter((r["doc_id"], r["term"], r["tf"], r["len"], r["bucket"]) for r in post.collect()), df, tuple(size)


STEM = ("ing", "ed", "es", "s")


def stem(t):
    return t if len(t) < 5 else next((t[: -len(s)] for s in STEM if t.endswith(s) and len(t) - len(s) >= 3), t)


def recount(texts):
    post, df, total = Counter(), Counter(), 0
    for i, text in texts:
        tokens = [stem(t) for t in re.findall(r"[a-z0-9']+", (text or "").lower())]
        total += len(tokens)
        for t, n in Counter(tokens).items():
            post[i, t, n, len(tokens)] += 1
            df[t] += 1
    return post, dict(df), (len(texts), total)


def without_bucket(post):
    out = Counter()
    for r, n in post.items():
        out[r[:4]] += n
    return out


def test_only_what_is_new_is_taken(spark, growing):
    at, add = growing
    add(0)
    add(1)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert index_documents.run(spark, settings(at)) == docs.where("doc_id % 3 < 2").count()
    assert index_documents.run(spark, settings(at)) == 0
    before = {p for p, _, _ in os.walk(at / "index")}
    add(2)
    assert index_documents.run(spark, settings(at)) == docs.where("doc_id % 3 = 2").count()
    assert index_documents.run(spark, settings(at)) == 0
    assert before < {p for p, _, _ in os.walk(at / "index")}
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    post, df, size = rows(spark, at)
    assert (without_bucket(post), df, size) == recount(texts)
    assert {b for *_, b in post} <= set(range(inverted.BUCKETS))


def test_many_batches_give_the_same_index(spark, growing):
    at, add = growing
    for k in range(4):
        add(k, 4)
    index_documents.run(spark, settings(at, files_in_batch=1))
    assert len(list((at / "index" / "sizes").glob("batch=*"))) == 4
    post, df, size = rows(spark, at)
    assert (without_bucket(post), df, size) == recount([tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()])


def test_a_failed_batch_is_replaced_whole(spark, growing, monkeypatch):
    at, add = growing
    add(0)
    index_documents.run(spark, settings(at))
    add(1)
    real = inverted.term_counts

    def fails(_):
        raise RuntimeError("lost")

    monkeypatch.setattr(inverted, "term_counts", fails)
    with pytest.raises(Exception, match="lost"):
        index_documents.run(spark, settings(at))
    assert (at / "index" / "postings" / "batch=1").exists() and not (at / "index" / "sizes" / "batch=1").exists()
    monkeypatch.setattr(inverted, "term_counts", real)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id % 3 < 2")
    assert index_documents.run(spark, settings(at)) == docs.where("doc_id % 3 = 1").count()
    post, df, size = rows(spark, at)
    assert (without_bucket(post), df, size) == recount([tuple(r) for r in docs.select("doc_id", "text").collect()])


ODD = [(1, "the dogs barked at the dog"), (2, None), (3, ""), (4, "..."), (5, "cats' cat CATS"), (5, "a dog again"), (None, "dog without id"), (7, "dog " * 500)]


def test_index_search_equals_a_pass_over_the_corpus(spark, tmp_path):
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None if i is None else i + 10**6, t) for i, t in ODD if i is not None], "doc_id long, text string")
    base.unionByName(odd).repartition(3).write.parquet(str(tmp_path / "documents"))
    index_documents.run(spark, settings(tmp_path, files_in_batch=1))
    post, terms, sizes = index_documents.tables(spark, str(tmp_path / "index"))
    asked = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question"))
    more = spark.createDataFrame([("x", "dog dog cats"), ("y", ""), ("z", "wordthatisnowhere"), ("n", None)], "query_id string, question string")
    asked = asked.unionByName(more)
    docs = spark.read.parquet(str(tmp_path / "documents"))
    unique = docs.groupBy("doc_id").count().where("count = 1").select("doc_id")
    forward = search.with_terms(docs.select("text", F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("tie")))
    key = lambda f: {(r["query_id"], r["rank"], r["id"], round(r["score"], 7)) for r in f.join(unique, F.col("id") == unique.doc_id.cast("string"), "left_semi").collect()}
    got, want = key(inverted.search(post, terms, sizes, asked, 6)), key(search.lexical(forward, asked, 6))
    assert got == want and {q for q, *_ in got} >= {"x", "0"} and not {q for q, *_ in got} & {"y", "z", "n"}


def test_a_search_reads_its_terms_only(spark, growing):
    at, add = growing
    for k in range(3):
        add(k)
    index_documents.run(spark, settings(at))
    post, terms, _ = index_documents.tables(spark, str(at / "index"))
    some = [r["term"] for r in terms.orderBy("df", "term").limit(2).collect()]
    found = inverted.matching(post, some)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    assert {r["term"] for r in found.collect()} == set(some) and found.count() < post.count() / 100
    scan = found._jdf.queryExecution().executedPlan()
    opened = {os.path.basename(os.path.dirname(f)) for f in found.inputFiles()}
    assert scan is not None and opened <= {f"bucket={b}" for b in range(inverted.BUCKETS)}


def test_many_terms_are_joined(spark, growing, monkeypatch):
    at, add = growing
    add(0)
    index_documents.run(spark, settings(at))
    post, terms, _ = index_documents.tables(spark, str(at / "index"))
    some = [r["term"] for r in terms.orderBy("term").limit(50).collect()]
    few = sorted(map(tuple, inverted.matching(post, some).select("doc_id", "term").collect()))
    monkeypatch.setattr(inverted, "TERMS_IN_FILTER", 10)
    assert sorted(map(tuple, inverted.matching(post, some).select("doc_id", "term").collect())) == few


def test_scores_by_hand(spark, tmp_path):
    spark.createDataFrame([(1, "red fox"), (2, "red red dog runs"), (3, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents"))
    index_documents.run(spark, settings(tmp_path))
    asked = spark.createDataFrame([("q", "red")], "query_id string, question string")
    got = {r["id"]: r["score"] for r in inverted.search(*index_documents.tables(spark, str(tmp_path / "index")), asked, 5).collect()}
    idf, mean = math.log(1 + 1.5 / 2.5), 6 / 3
    want = {i: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean)) for i, tf, n in (("1", 1, 2), ("2", 2, 4))}
    assert got == pytest.approx(want)


def answers(at):
    return answer_questions.Settings(str(at / "documents"), str(at / "questions"), str(at / "index"), str(at / "answers"))


def test_answers_follow_the_documents_and_repeat(spark, growing):
    at, add = growing
    spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(9001, "What documents do you have?"), (9002, ""), (9003, None)], "item_id long, text string")).write.parquet(str(at / "questions"))
    add(0)
    add(1)
    first = sorted(map(tuple, answer_questions.run(spark, answers(at)).collect()), key=str)
    assert sorted(map(tuple, answer_questions.run(spark, answers(at)).collect()), key=str) == first
    assert any(d.name == "intent=inventory" for d in (at / "answers").iterdir()) and {r[0] for r in first} >= {9001, 9002, 9003}
    assert all(escalated == (answer is None) for _, answer, _, _, escalated, _ in first) and {r[0] for r in first if r[4]} >= {9002, 9003}
    add(2)
    grown = sorted(map(tuple, answer_questions.run(spark, answers(at)).collect()), key=str)
    assert grown != first and len(list((at / "index" / "sizes").glob("batch=*"))) == 2
    fresh = answer_questions.Settings(str(at / "documents"), str(at / "questions"), str(at / "index2"), str(at / "answers2"))
    assert sorted(map(tuple, answer_questions.run(spark, fresh).collect()), key=str) == grown


def test_settings_files_and_refusals():
    for job in (index_documents, answer_questions):
        with open(f"jobs/{job.__name__.split('.')[-1]}.json", encoding="utf-8") as f:
            assert common.settings(job.Settings, json.load(f)).output
    with pytest.raises(ValueError, match="unknown settings: outptu"):
        common.settings(index_documents.Settings, {"outptu": "x"})
    with pytest.raises(TypeError):
        common.settings(index_documents.Settings, {"documents": "x"})


def test_command_line(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    args = [f"documents={DATA}/documents.parquet", f"output={tmp_path}/index", f"checkpoint={tmp_path}/checkpoint"]
    env = os.environ | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-m", "jobs.index_documents", f"{root}/jobs/index_documents.json", *args], cwd=root, env=env, capture_output=True, text=True, timeout=300, check=True)
    assert "took 200 new documents in 1 batches" in done.stderr and (tmp_path / "index" / "postings" / "batch=0").is_dir()
