"""Every dealt operator and every pipeline stage on nulls, empty and long texts, repeated rows, clashing names and empty tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quernstone.llm import bpe, decontaminate, jaccard_join, language, pii, quality, shard, token_count, topk, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = ("digest", "regions", "rejected", "clean", "node", "sig", "score", "size", "unit", "shard", "kept", "more_regions", "class_id", "words", "toxic", "quality")
LONG = "word number one and two " * 8000
ROWS = [
    (1, "A plain text of several words that is here only once, really.", "en", "a", 60), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "A text without an id but with some words in it.", "en", None, 1),
    (5, LONG, "en", "b", 1), (6, LONG, "en", "b", 1), (7, "twice the same row of words here", "de", "b", 1), (7, "twice the same row of words here", "de", "b", 1), (8, " \n\t ", None, "b", 1), (9, "!!! ... 123", "fr", "b", 1),
    (10, "Mail a.b@c.de or 10.0.0.1, +1 (555) 555-1234.", "en", "b", 1), (11, None, "en", "b", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(ROWS, DOC)
    for c in CLASH:
        out = out.withColumn(c, F.lit("clash"))
    return out.repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(12)] + [(1, None, None), (None, 1, True)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int")).withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Mail a.b@c.de or 10.0.0.1"), (2, None), (3, ""), (4, "!!"), (5, "once")], "item_id long, text string").withColumn("score", F.lit(0))


def operators(labels, benchmark):
    path = bpe.tokenizer_path()
    return {
        "shard": shard.shard, "bpe": lambda d: bpe.bpe_encode(d, path), "language": language.identify, "decontaminate": lambda d: decontaminate.decontaminate(d, benchmark), "quality": lambda d: quality.quality(d, labels),
        "pii": pii.find_pii, "tokens": lambda d: token_count.token_counts(d, path), "toxicity": lambda d: toxicity.toxicity(d, labels), "jaccard": jaccard_join.near_duplicates,
    }


NAMES = ["shard", "bpe", "language", "decontaminate", "quality", "pii", "tokens", "toxicity", "jaccard"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_each(docs, labels, benchmark, name):
    rows = operators(labels, benchmark)[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(none, labels, benchmark, name):
    assert operators(labels, benchmark)[name](none).collect() == []


def test_no_labels_no_benchmark(docs, labels, benchmark):
    assert {r["score"] for r in quality.quality(docs, labels.where("false")).collect()} == {0.5}
    assert {r["rejected"] for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0}
    assert {r["contaminated"] for r in decontaminate.decontaminate(docs, benchmark.where("false")).collect()} == {0}


def test_defined_results(docs, labels, benchmark):
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    lang = by(language.identify(docs))
    assert [lang[i]["lang_pred"] for i in (2, 3, 8, 9)] == ["und"] * 4 and lang[2]["score"] == 0
    n = by(token_count.token_counts(docs, bpe.tokenizer_path()))
    assert (n[2]["n_bytes"], n[2]["n_tokens"], n[3]["n_tokens"]) == (0, 0, 0) and n[5]["over_limit"]
    near = by(jaccard_join.near_duplicates(docs))
    assert (near[6]["class_id"], near[6]["kept"], near[5]["kept"], near[7]["n_copies"], near[11]["class_id"]) == (5, 0, 1, 2, 2)
    found = by(decontaminate.decontaminate(docs, benchmark))
    assert found[10]["items"] == [1] and found[1]["items"] == [5] and found[2]["items"] == []
    spans = by(pii.find_pii(docs))
    assert spans[10]["spans"] == "email:5:13,ip:17:25,phone:27:44" and spans[2]["spans"] == ""


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns(spark, docs, none, labels, benchmark, tmp_path, k):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, str(tmp_path))
    assert set(out.columns) == set(docs.columns) and dict(out.dtypes) == dict(docs.dtypes)
    assert {r["regions"] for r in out.collect()} == {"clash"}
    assert stage(spark, none, str(tmp_path)).collect() == []


def test_bpe_stage(spark, docs, none, tmp_path):
    """A row for each row, null and empty texts without tokens, equal texts with equal digests."""
    stage = dict(corpus_pipeline.STAGES)["bpe"]
    rows = stage(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 0 and by[2]["ids_sha256"] == by[3]["ids_sha256"]
    assert by[5]["ids_sha256"] == by[6]["ids_sha256"] and by[5]["n_tokens"] == 8000 * 5
    assert stage(spark, none, str(tmp_path)).collect() == []


def test_which_rows_the_join_stage_keeps(spark, docs, tmp_path):
    """Null texts are one class, equal texts another, a repeated row stays once, rows without an id stay."""
    kept = [(r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, str(tmp_path)).collect()]
    want = {(r[0], r[1]) for r in ROWS} - {(11, None), (6, LONG)}
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    got = [tuple(r) for r in topk.top_k(v, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 6, 65536), (0, 4, None, 65536), (0, 5, 100, 32768), (100, 1, None, 65536), (100, 2, 0, 32768), (100, 3, 1, 32768), (100, 4, 2, 32768), (100, 5, 6, 32768)]
    assert topk.top_k(v.where("false"), F.col("vec_id") % 50 == 0).collect() == []
