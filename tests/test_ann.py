"""Approximate search: the exact one where all is probed, recall elsewhere, hot cells, odd vectors, added rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import ann, search

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    return v.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("tie"), F.col("embedding").cast("array<double>").alias("vector"))


@pytest.fixture(scope="module")
def questions(vectors):
    return vectors.where("tie % 50 = 0").select(F.col("id").alias("query_id"), "vector")


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return ann.CellIndex.build(vectors, str(tmp_path_factory.mktemp("ann") / "index"))


def key(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 7)) for r in df.collect())


def test_every_vector_is_indexed_once(index, vectors):
    rows = index.rows().collect()
    assert sorted(r["id"] for r in rows) == sorted(r["id"] for r in vectors.collect())
    assert {len(r["code"]) for r in rows} == {16} and {r["cell"] for r in rows} <= set(range(len(index.quantiser.centres)))


def test_probing_and_keeping_all_is_the_exact_search(index, vectors, questions):
    n = vectors.count()
    assert key(index.search(vectors, questions, 10, probes=10**6, keep=n)) == key(search.dense(vectors, questions, 10))


def test_recall_of_the_defaults_and_less_work(index, vectors, questions):
    exact = search.dense(vectors, questions, 10)
    few, more = (ann.recall(index.search(vectors, questions, 10, probes=p, keep=k), exact).first() for p, k in ((1, 10), (len(index.quantiser.centres) // 2, 200)))
    assert more["wanted"] == 10 * more["questions"] and more["recall"] >= 0.9 and few["recall"] < more["recall"]


def test_estimates_are_near_the_cosines(index, vectors):
    rows = vectors.limit(200).collect()
    x = np.array([r["vector"] for r in rows], dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cell, code = index.quantiser.encode(x)
    for c in np.unique(cell)[:5]:
        own = np.flatnonzero(cell == c)
        got, want = index.quantiser.estimate(x[:20], int(c), code[own]), x[:20] @ x[own].T
        assert np.abs(got - want).mean() < 0.1


def test_hot_cells_odd_vectors_and_added_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = [(f"h{i}", i, [1.0, 0.0, 0.0, 0.0]) for i in range(400)] + [(f"r{i}", 1000 + i, rng.normal(size=4).tolist()) for i in range(300)] + [("zero", 5000, [0.0] * 4), ("none", 5001, None)]
    df = spark.createDataFrame(rows, "id string, tie long, vector array<double>")
    index = ann.CellIndex.build(df.where("id <> 'r7'"), str(tmp_path / "index"), cells=8, pieces=2)
    index.add(df.where("id = 'r7'"))
    got = index.rows().groupBy("cell", "part").count().collect()
    assert sum(r["count"] for r in got) == 701 and max(r["count"] for r in got) < 120
    asked = spark.createDataFrame([("a", [2.0, 0.1, 0.0, 0.0]), ("b", rows[407][2]), ("z", [0.0] * 4)], "query_id string, vector array<double>")
    assert key(index.search(df, asked, 7, probes=8, keep=701)) == key(search.dense(df, asked, 7))
    assert {r["query_id"] for r in index.search(df, asked, 3).collect()} == {"a", "b"}
    assert index.search(df, asked.where("false"), 3).collect() == []


def test_lloyd_finds_far_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.01, (50, 2)) for c in ((0, 0), (5, 5), (9, 0))]).astype(np.float32)
    centres = ann.lloyd(x, 3, 1, 30)
    assert len(ann.lloyd(x[:2], 5, 1)) == 2
    assert ((x[:, None] - centres[None]) ** 2).sum(2).min(1).max() < 30 and len(centres) == 3
