"""The engine behind its vector store: its own table, a table of points and one that is given see the same."""

import pytest
from pyspark.sql import functions as F

from quernstone.config import Settings
from quernstone.operators.store import Log
from quernstone.operators.vectors import TableStore, build_vector_store
from quernstone.plans.engine import Engine, OwnChunks
from quernstone.sources.extract import DOCUMENT


def documents(spark, *numbers, words="harbour goat ferry"):
    rows = [(f"d{i}", f"f{i}.md", "text", [(f"Section {k} of {i}: {words} {'captain ' * (i % 3)}{'wind ' * k}stands here for the search.", f"s{k}", k) for k in range(3)], {}, None, 201) for i in numbers]
    return spark.createDataFrame(rows, DOCUMENT)


@pytest.fixture
def engines(spark, tmp_path):
    given = TableStore(Log(spark, str(tmp_path / "given")), 384)
    return {
        "own": Engine(spark, str(tmp_path / "own")), "points": Engine(spark, str(tmp_path / "points"), Settings(vector_backend="qdrant")), "given": Engine(spark, str(tmp_path / "third"), store=given),
    }


def seen(spark, engine):
    questions = spark.createDataFrame([("a", "goat on the ferry"), ("b", "captain in the wind"), ("c", "nothing of it zzz")], "query_id string, question string")
    out = {m: sorted((r["query_id"], r["rank"], r["citation"], r["score"]) for r in engine.search(questions, m, 5).collect()) for m in ("dense", "lexical", "hybrid")}
    asked = sorted((r["query_id"], r["text"], r["escalated"]) for r in engine.ask(questions).collect())
    return out, asked, engine.stats(), sorted(r["chunk_id"] for r in engine.store.all_chunks().select("chunk_id").collect())


def test_all_stores_give_the_same_through_every_change(spark, engines):
    assert isinstance(engines["own"].store, OwnChunks) and isinstance(engines["points"].store, TableStore)

    def same():
        first, *rest = (seen(spark, e) for e in engines.values())
        assert all(r == first for r in rest)
        return first

    for e in engines.values():
        e.ingest_documents(documents(spark, *range(5))).count()
    assert same()[2] == {"documents": 5, "chunks": 15, "indexed_chunks": 15}
    for e in engines.values():
        e.ingest_documents(documents(spark, 1, 2, words="another text about ropes")).count()
    text = same()
    assert text[2]["indexed_chunks"] == 15
    for e in engines.values():
        assert e.delete("d3") == 3 and e.delete("nowhere") is None
        assert e.delete_all(spark.createDataFrame([("d0",), ("d4",), ("x",)], "doc_id string")) == 2
    assert same()[2] == {"documents": 2, "chunks": 6, "indexed_chunks": 6}
    for e in engines.values():
        e.compact()
    assert same()[2]["documents"] == 2


def test_dense_searches_go_through_the_store(spark, tmp_path):
    class Counting(TableStore):
        searches = 0

        def search(self, questions, limit=8):
            Counting.searches += 1
            return super().search(questions, limit).where(F.col("rank") == 1)

    engine = Engine(spark, str(tmp_path / "root"), store=Counting(Log(spark, str(tmp_path / "log")), 384))
    engine.ingest_documents(documents(spark, *range(5))).count()
    questions = spark.createDataFrame([("a", "goat on the ferry")], "query_id string, question string")
    assert engine.search(questions, "dense", 5).count() == 1 and Counting.searches == 1
    engine.search(questions, "hybrid", 5)
    engine.rankings(questions)
    assert Counting.searches == 3


def test_kinds(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    own = OwnChunks(None)
    assert build_vector_store("memory", log, 3, own) is own and isinstance(build_vector_store("memory", log, 3), TableStore) and isinstance(build_vector_store("qdrant", log, 3, own), TableStore)
    with pytest.raises(ValueError):
        build_vector_store("other", log, 3)


def test_documents_of_a_table_are_deleted_in_one_commit(spark, tmp_path):
    store = TableStore(Log(spark, str(tmp_path / "log")), 2)
    store.upsert(spark.createDataFrame([(f"c{i}", f"d{i % 4}", "t", [1.0, float(i)]) for i in range(12)], "chunk_id string, doc_id string, text string, vector array<double>"))
    version = store.log.manifest()["version"]
    ids = spark.createDataFrame([("d1",), ("d1",), ("d3",), ("none",)], "doc_id string")
    assert store.delete_documents(ids) == 6 and store.count() == 6 and store.log.manifest()["version"] == version + 1
    assert store.delete_documents(ids) == 0 and store.log.manifest()["version"] == version + 1
