"""Commits that meet, repeated ids, the refusal curve, metadata in a database, and limits that are settings."""

import random
import time
import uuid
import zipfile

import pytest

from quernstone import config
from quernstone.operators import evaluate
from quernstone.operators.metadata import JdbcMetadata
from quernstone.operators.store import CommitConflict, Log
from quernstone.operators.vectors import TableStore
from quernstone.plans.engine import Engine
from quernstone.sources.extract import DOCUMENT


def test_two_commits_cannot_become_one_version(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    rows = lambda v: spark.createDataFrame([(1, v)], "x int, version long")
    first = log.manifest()["version"] + 1
    assert log.commit({"t": rows(first)}, version=first) == first
    with pytest.raises(CommitConflict):
        log.commit({"t": rows(first)}, version=first)
    assert log.read("t", "x int, version long").count() == 1
    inner = Log(spark, str(tmp_path / "log"))

    class Late:
        """A table whose writing lets another commit come between."""

        @property
        def write(self):
            inner.commit({"t": rows(2)}, version=2)
            return rows(2).write

    with pytest.raises(CommitConflict):
        log.commit({"t": Late()}, version=2)
    assert log.manifest()["version"] == 2 and log.read("t", "x int, version long").where("version = 2").count() == 1


def test_an_ingest_that_was_overtaken_fails_and_changes_nothing(spark, tmp_path, monkeypatch):
    docs = lambda *names: spark.createDataFrame([(n, n, "text", [(f"the text of {n} is here", "body", 0)], {}, None, 201) for n in names], DOCUMENT)
    engine, other = Engine(spark, str(tmp_path / "root")), Engine(spark, str(tmp_path / "root"))
    real = engine.log.commit

    def late(added, **more):
        other.ingest_documents(docs("b")).count()
        return real(added, **more)

    monkeypatch.setattr(engine.log, "commit", late)
    with pytest.raises(CommitConflict):
        engine.ingest_documents(docs("a"))
    monkeypatch.setattr(engine.log, "commit", real)
    assert [r["doc_id"] for r in engine.documents().collect()] == ["b"]
    assert engine.ingest_documents(docs("a")).count() == 1 and engine.stats() == {"documents": 2, "chunks": 2, "indexed_chunks": 2}


def test_repeated_ids_in_a_batch_give_one_document_always_the_same(spark, tmp_path):
    rows = [("x", "x", "text", [(f"text number {i}", "body", 0)], {}, None, 201) for i in range(20)]
    found = set()
    for n in (1, 7):
        engine = Engine(spark, str(tmp_path / f"root{n}"))
        engine.ingest_documents(spark.createDataFrame(rows if n == 1 else rows[::-1], DOCUMENT).repartition(n)).count()
        found.add(tuple(r["text"] for r in engine.chunks().collect()))
    assert len(found) == 1 and len(next(iter(found))) == 1
    store = TableStore(Log(spark, str(tmp_path / "points")), 2)
    store.upsert(spark.createDataFrame([("c", "d", f"t{i}", [1.0, float(i)]) for i in range(9)], "chunk_id string, doc_id string, text string, vector array<double>").repartition(5))
    assert [r["text"] for r in store.all_chunks().collect()] == ["t8"]


def plain_rates(rows, floor):
    up = lambda s, refused: refused or s is None or s < floor
    no, yes = [r for r in rows if not r[0]], [r for r in rows if r[0]]
    return sum(not up(s, x) for _, s, x in no) / len(no) if no else 0.0, sum(up(s, x) for _, s, x in yes) / len(yes) if yes else 0.0


@pytest.mark.parametrize("seed", range(3))
def test_refusal_curve_and_sweep_by_hand(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.random() < 0.7, None if rng.random() < 0.1 else round(rng.random(), 2), rng.random() < 0.1) for _ in range(80)]
    df = spark.createDataFrame(rows, "answerable boolean, score double, refused boolean").repartition(4)
    curve = {r["floor"]: (r["false_answer_rate"], r["wrongly_refused_rate"]) for r in evaluate.refusal_curve(df, 2).collect()}
    assert set(curve) == {s for _, s, x in rows if s is not None and not x}
    assert all(got == pytest.approx(plain_rates(rows, f)) for f, got in curve.items())
    floors = [0.0, 0.1, 0.33, 0.9, 2.0]
    sweep = {r["floor"]: (r["false_answer_rate"], r["wrongly_refused_rate"]) for r in evaluate.refusal_sweep(df, floors).collect()}
    assert all(sweep[f] == pytest.approx(plain_rates(rows, f)) for f in floors)
    best = evaluate.best_floor(evaluate.refusal_curve(df, 2), 3.0, 1.0).first()
    assert best["cost"] == pytest.approx(min(3 * a + b for a, b in curve.values()))
    none = df.where("false")
    assert evaluate.refusal_curve(none).collect() == [] and [tuple(r) for r in evaluate.refusal_sweep(none, [0.1]).collect()] == [(0.1, 0, 0, 0.0, 0.0)]


def test_sweep_of_the_engine_equals_asking_at_each_floor(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "root"))
    rng = random.Random(4)
    words = "harbour goat ferry captain wind sleep deck owner rope sail anchor storm".split()
    docs = [(f"d{i}", f"d{i}", "text", [(" ".join(rng.choices(words, k=30)) + ".", "body", 0)], {}, None, 201) for i in range(30)]
    engine.ingest_documents(spark.createDataFrame(docs, DOCUMENT)).count()
    asked = [(str(i), " ".join(rng.choices([*words, "unknown", "zebra", "of"], k=6)), ["x"] if i % 3 else []) for i in range(20)] + [("20", "  ", []), ("21", "which documents are there", ["x"])]
    questions = spark.createDataFrame(asked, "query_id string, question string, relevant array<string>")
    floors = [0.1, 0.3, 0.5, 0.7]
    sweep = {r["floor"]: r.asDict() for r in engine.refusal_sweep(questions, floors).collect()}
    for f in floors:
        one = engine.evaluate_refusal(questions, f)
        assert {k: sweep[f][k] for k in one} == pytest.approx(one)


@pytest.fixture
def metadata(spark):
    return JdbcMetadata(spark, f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true")


def records(spark, *rows):
    return spark.createDataFrame(rows, "doc_id string, filename string, source_type string, section_count int, chunk_count int")


def test_jdbc_upsert_get_and_list(spark, metadata):
    assert metadata.upsert(records(spark, ("a", "z.txt", "text", 1, 2), ("f", "b.md", "text", 3, 4), ("4c", "b.md", "text", 0, 0))) == 3
    assert metadata.get("a").first()["chunk_count"] == 2 and metadata.get("nowhere").first() is None and metadata.get("a' or '1'='1").first() is None
    assert [r["doc_id"] for r in metadata.documents().collect()] == ["4c", "f", "a"]
    assert metadata.documents().columns == ["doc_id", "filename", "source_type", "section_count", "chunk_count", "ingested_at"]


def test_jdbc_upsert_replaces_every_field(spark, metadata):
    metadata.upsert(records(spark, ("a", "z.txt", "text", 1, 2)))
    before = metadata.get("a").first()
    time.sleep(0.01)
    metadata.upsert(records(spark, ("a", "y.txt", "html", 5, 6), ("b", "x", "text", 1, 1)))
    after = metadata.get("a").first()
    assert (after["filename"], after["source_type"], after["section_count"], after["chunk_count"]) == ("y.txt", "html", 5, 6) and after["ingested_at"] > before["ingested_at"]
    assert metadata.stats() == {"documents": 2, "chunks": 7}


def test_jdbc_delete_and_stats(spark, metadata):
    assert metadata.stats() == {"documents": 0, "chunks": 0}
    metadata.upsert(records(spark, ("a", "a", "text", 1, 2), ("b", "b", "text", 1, 5)))
    assert metadata.delete("a") and not metadata.delete("a") and metadata.stats() == {"documents": 1, "chunks": 5}


def test_jdbc_repeated_ids_failed_upserts_and_names(spark, metadata):
    assert metadata.upsert(records(spark, *[("a", f"f{i}", "text", i, i) for i in range(9)]).repartition(4)) == 1 and metadata.get("a").first()["filename"] == "f8"
    with pytest.raises(Exception):  # noqa: B017  a file name is missing
        metadata.upsert(records(spark, ("b", "b", "text", 1, 1), ("c", None, "text", 1, 1)))
    assert [r["doc_id"] for r in metadata.documents().collect()] == ["a"]
    assert JdbcMetadata(spark, metadata.url).stats()["documents"] == 1  # the table is there already
    for url, table in (("sqlite://x", "documents"), (metadata.url, "a; drop table b")):
        with pytest.raises(ValueError):
            JdbcMetadata(spark, url, table)


def test_mirror_follows_the_engine(spark, tmp_path):
    url = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true"
    engine = Engine(spark, str(tmp_path / "root"), config.Settings(database_url=url))
    docs = [(f"d{i}", f"f{i}", "text", [(f"the text of {i}", "body", 0)], {}, None, 201) for i in range(5)]
    engine.ingest_documents(spark.createDataFrame(docs, DOCUMENT)).count()
    assert engine.mirror_documents() == 5
    engine.delete("d1")
    assert engine.mirror_documents() == 4
    there = JdbcMetadata(spark, url)
    assert [tuple(r)[:5] for r in there.documents().collect()] == [tuple(r)[:5] for r in engine.documents().collect()]


def test_sheet_rows_are_a_setting(spark, tmp_path):
    assert config.Settings().sheet_max_rows == 2001
    path = tmp_path / "big.xlsx"
    cells = "".join(f'<row><c t="inlineStr"><is><t>{"name" if i == 0 else f"v{i}"}</t></is></c></row>' for i in range(2500))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="s" r:id="i1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="i1" Type="x/worksheet" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>")
    for rows, last in ((2001, "v2000"), (0, "v2499"), (11, "v10")):
        engine = Engine(spark, str(tmp_path / f"root{rows}"), config.Settings(sheet_max_rows=rows))
        engine.ingest(str(path)).count()
        text = " ".join(r["text"] for r in engine.chunks().collect())
        assert f"name: {last}" in text and f"name: v{int(last[1:]) + 1}" not in text
