"""Small cases of a review's findings."""

import hashlib

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quernstone.functions import text as T
from quernstone.operators import arrow, embed
from quernstone.operators.arrow import spread
from quernstone.plans.engine import Engine
from quernstone.sources import extract as X
from quernstone.sources.extract import DOCUMENT


def both(spark, folder, name, **tables):
    """A query's rows and its SQL's over tables of (schema, rows), sorted."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(folder))
    want = con.execute(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


DOCUMENTS = "doc_id long, text string"


def test_upper_case_keeps_a_texts_length(spark, tmp_path):
    texts = ["Straße ﬁx aß", "ßß", "plain", "", None, "ŉ ǰ ΰ ᾳ 文"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(T.upper(F.col("x"))).collect()]
    assert got == ["STRAẞE ﬁX Aẞ", "ẞẞ", "PLAIN", "", None, "ŉ ǰ ΰ ᾼ 文"]
    assert all(len(a) == len(b) for a, b in zip(got, texts, strict=True) if b is not None)
    long = "Das ist groß. " * 300  # more ß than a chunk has room for
    got, want = both(spark, tmp_path, "engine_reingest", documents=(DOCUMENTS, [(1, long), (2, long), (3, "x ß")]), labels=("doc_id long, toxic int", [(1, 1), (3, 1)]))
    assert got == want and len(got) == 3


def test_references_without_a_semicolon(spark, tmp_path):
    page = "<html><title>a&amp;&amp</title><body><p>x &ampy; &amp;lt; &lt &copy;</p><h1>T&amp</h1><p>z & &quot;q&quot;</p></body></html>"
    got, want = both(spark, tmp_path, "html_page_sections", pages=("page_id long, html string", [(1, page)]))
    assert got == want and got[0][3].startswith("a&&amp")
    assert X.html_sections(page)[0][0][0].startswith("a&&x &y; <")  # files are still read as browsers do


def test_whole_sheets(spark, tmp_path):
    rows = [(i, f"C{i}", i % 2, "SEG") for i in range(1, 2600)]  # over 1,000 rows a sheet
    got, want = both(spark, tmp_path, "sheet_lines", customer=("c_custkey long, c_name string, c_nationkey int, c_mktsegment string", rows))
    sheet = X.row_lines([["name", "", "key"], *([n, "" if k % 3 == 0 else s, str(k), "beyond"] for k, n, nation, s in rows if nation == 1)])
    assert got == want and [r[0] for r in got] == [0, 1] and got[1][1:] == (hashlib.md5(sheet.encode()).hexdigest(), len(sheet))


def test_every_line_of_the_sheets(spark, tmp_path):
    schema = "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"
    rows = [(i, f"C{i}", i % 2, "SEG") for i in range(1, 2600)]
    got, want = both(spark, tmp_path / "a", "sheet_rows", customer=(schema, rows))
    assert got == want and len(got) == len(rows) and got[0] == (0, 2, "name: C2 | col2: SEG | key: 2")
    sheets = {n: "\n".join(line for nation, _, line in got if nation == n) for n in (0, 1)}
    digests = entry.queries()["sheet_lines"](spark, str(tmp_path / "a")).collect()
    assert sorted(map(tuple, digests)) == [(n, hashlib.md5(t.encode()).hexdigest(), len(t)) for n, t in sorted(sheets.items())]
    odd = [(1, None, 0, "SEG"), (2, "", 0, None), (3, "C3", 0, "SEG"), (4, "C4", 0, ""), (4, "C4", 0, "")]
    got, want = both(spark, tmp_path / "b", "sheet_rows", customer=(schema, odd))
    assert got == want and [r[2] for r in got] == ["col2: SEG | key: 1", "key: 2", "name: C3 | key: 3", "name: C4 | key: 4", "name: C4 | key: 4"]


def test_spread_by_rows(spark, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/one")
    rows = spark.read.parquet(f"{tmp_path}/one")
    out = spread(rows, rows=1000)
    assert rows.rdd.getNumPartitions() == 1 and out.rdd.getNumPartitions() == 5 and out.count() == 5000
    assert spread(rows.where("id < 0")).count() == 0


def test_slices_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 300, "", None, "y" * 50, "z" * 1000, "a"]), pa.array([["q" * 40]] * 6)], names=["t", "l"])
    cut = [b.column(0).to_pylist() for b in arrow.slices(batch, [0], rows=4, size=310)]
    assert sum(cut, []) == batch.column(0).to_pylist() and [len(c) for c in cut] == [3, 1, 1, 1]
    assert [b.num_rows for b in arrow.slices(batch, [1], rows=4, size=100)] == [2, 2, 2] and [b.num_rows for b in arrow.slices(batch, [0], rows=2)] == [2, 2, 2]


def test_vectors_in_windows(monkeypatch):
    texts = ["", "alpha beta alpha " * 50, "é!", "gamma's", "alpha " * 7, "", "delta"]
    want = embed.hashed(texts, 64)
    for name, value in (("TOKENS_AT_ONCE", 3), ("WHOLE", 10), ("TOKENS_KEPT", 2)):
        monkeypatch.setattr(embed, name, value)
        monkeypatch.setattr(embed, "_buckets", {})
        assert (embed.hashed(texts, 64) == want).all()
    assert want[1].any() and not want[0].any() and abs((want[1] ** 2).sum() - 1) < 1e-12


def test_chunks_are_not_shuffled(spark, tmp_path):
    texts = lambda *rows: spark.createDataFrame([(i, f"{i}.txt", "text", [(t, "body", 0)], {}, None, 201) for i, t in rows], DOCUMENT)
    e = Engine(spark, str(tmp_path / "e"))
    plan = lambda: e.chunks()._jdf.queryExecution().executedPlan().toString()
    got = e.ingest_documents(texts(("a", "one"), ("b", "two"), ("a", "three"), (None, "n1"), (None, "n2"))).collect()
    assert len(got) == 5 and sorted(r["doc_id"] or "" for r in e.chunks().collect()) == ["", "a", "b"]
    assert "Exchange" not in plan() and "Join" not in plan()
    e.ingest_documents(texts(("b", "four")))
    assert e.delete("a") == 1 and {r["text"] for r in e.chunks().collect()} >= {"four"} and e.chunks().where("doc_id is not null").count() == 1
    assert "BroadcastHashJoin" in plan() and "hashpartitioning" not in plan()
    e.ingest_documents(texts(("a", "five")))
    assert sorted(r["text"] for r in e.chunks().where("doc_id is not null").collect()) == ["five", "four"]
