"""Keeping an index in step with a folder: only changed files are opened, what left is deleted, stopped runs are made good."""

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from quernstone.plans import engine as module
from quernstone.plans.engine import Engine


def put(folder, name, text, at):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))
    return path


@pytest.fixture
def place(spark, tmp_path):
    folder = tmp_path / "files"
    for i in range(4):
        put(folder, f"f{i}.md", f"# Title {i}\nThe text number {i} of the folder.", 1_700_000_000 + i)
    return Engine(spark, str(tmp_path / "root")), folder


def names(engine):
    return sorted(r["filename"] for r in engine.documents().collect())


def opened(monkeypatch):
    """Records which files' contents are extracted."""
    seen, real = [], module.extract

    def spy(files, *limits):
        seen.extend(pathlib.Path(r["path"]).name for r in files.select("path").collect())
        return real(files, *limits)

    monkeypatch.setattr(module, "extract", spy)
    return seen


def test_only_changed_files_are_opened(place, monkeypatch):
    engine, folder = place
    seen = opened(monkeypatch)
    assert engine.sync(str(folder)) == {"listed": 4, "read": 4, "gone": 0, "deleted": 0} and len(seen) == 4
    seen.clear()
    assert engine.sync(str(folder)) == {"listed": 4, "read": 0, "gone": 0, "deleted": 0} and not seen
    put(folder, "f1.md", "# Title 1\nAnother text now.", 1_700_000_100)
    put(folder, "deep/f9.md", "# Nine\nA new file in a folder inside.", 1_700_000_101)
    assert engine.sync(str(folder)) == {"listed": 5, "read": 2, "gone": 0, "deleted": 1} and sorted(seen) == ["f1.md", "f9.md"]
    assert names(engine) == ["f0.md", "f1.md", "f2.md", "f3.md", "f9.md"]
    text = " ".join(r["text"] for r in engine.chunks().collect())
    assert "Another text now" in text and "text number 1 of" not in text


def test_the_scan_of_contents_is_filtered_by_time(spark, place):
    engine, folder = place
    engine.sync(str(folder))
    plan = module.read_files(spark, str(folder)).where(F.col("modificationTime") >= F.lit("2023-11-14 22:13:22").cast("timestamp"))
    assert "PushedFilters" in plan._jdf.queryExecution().executedPlan().toString() and "modificationTime" in plan._jdf.queryExecution().executedPlan().toString()


def test_removed_and_shared_files(place):
    engine, folder = place
    put(folder, "twin/f0.md", "# Title 0\nThe text number 0 of the folder.", 1_700_000_050)  # the same name and content
    assert engine.sync(str(folder))["read"] == 5 and names(engine) == [f"f{i}.md" for i in range(4)]
    (folder / "f0.md").unlink()
    (folder / "f2.md").unlink()
    assert engine.sync(str(folder)) == {"listed": 3, "read": 0, "gone": 2, "deleted": 1} and names(engine) == ["f0.md", "f1.md", "f3.md"]
    (folder / "twin/f0.md").unlink()
    assert engine.sync(str(folder))["deleted"] == 1 and names(engine) == ["f1.md", "f3.md"]
    assert engine.sync(str(folder)) == {"listed": 2, "read": 0, "gone": 0, "deleted": 0}


def test_a_stopped_sync_is_made_good(place, monkeypatch):
    engine, folder = place
    engine.sync(str(folder))
    put(folder, "f1.md", "# Title 1\nAnother text now.", 1_700_000_100)
    (folder / "f3.md").unlink()
    real = engine.log.commit

    def stops(added, **more):
        if "files" in added:
            raise RuntimeError("stopped")
        return real(added, **more)

    monkeypatch.setattr(engine.log, "commit", stops)
    with pytest.raises(RuntimeError):
        engine.sync(str(folder))
    monkeypatch.setattr(engine.log, "commit", real)
    assert engine.sync(str(folder)) == {"listed": 3, "read": 1, "gone": 1, "deleted": 2}
    fresh = Engine(engine.spark, str(folder.parent / "root2"))
    fresh.sync(str(folder))
    assert {(r["doc_id"], r["filename"]) for r in engine.documents().collect()} == {(r["doc_id"], r["filename"]) for r in fresh.documents().collect()}


def test_unreadable_files_and_two_folders(place):
    engine, folder = place
    put(folder, "bad.docx", "no archive", 1_700_000_060)
    put(folder.parent / "other", "o.txt", "A text of the other folder.", 1_700_000_000)
    assert engine.sync(str(folder))["read"] == 5 and engine.sync(str(folder))["read"] == 0
    assert engine.sync(str(folder.parent / "other")) == {"listed": 1, "read": 1, "gone": 0, "deleted": 0} and len(names(engine)) == 5
    (folder.parent / "other" / "o.txt").unlink()
    put(folder.parent / "other", "p.txt", "Something else.", 1_700_000_001)
    assert engine.sync(str(folder.parent / "other"))["deleted"] == 1 and "p.txt" in names(engine)


def test_delete_all(spark, place):
    engine, folder = place
    engine.sync(str(folder))
    ids = engine.documents().limit(3).select("doc_id").unionByName(spark.createDataFrame([("nowhere",)], "doc_id string"))
    ids = ids.unionByName(ids)
    version = engine.log.manifest()["version"]
    assert engine.delete_all(spark.createDataFrame(ids.collect(), "doc_id string")) == 3
    assert engine.log.manifest()["version"] == version + 1 and engine.stats() == {"documents": 1, "chunks": 1, "indexed_chunks": 1}
    assert engine.delete_all(spark.createDataFrame([], "doc_id string")) == 0 and engine.log.manifest()["version"] == version + 1
