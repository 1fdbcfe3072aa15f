"""Sources, retrieval, answers, evaluation, storage and the engine end to end."""

import io
import json
import math
import zipfile
from types import SimpleNamespace as N

import pytest
from pyspark.sql import functions as F

from quernstone.config import Settings
from quernstone.operators import answer as A
from quernstone.operators import evaluate as E
from quernstone.operators import search as S
from quernstone.operators import store
from quernstone.operators.embed import ModelEmbedder
from quernstone.operators.rerank import CrossEncoderReranker, NoReranker, OverlapReranker, build_reranker
from quernstone.plans.engine import Engine, build_vector_store
from quernstone.sources import extract as X
from quernstone.sources.questions import load_questions

HANDBOOK = """# Password reset
To reset your password open Settings and choose Reset Password. A confirmation email is sent.
# Billing
Seats are billed monthly and are pro-rated when they change. Invoices are issued on the first day.
# Troubleshooting
The error ERR_LOCK_TIMEOUT means that a worker waited too long for a lock. Restart the worker pool."""


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S_ = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def docx():
    p = lambda t, s="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Intro line") + p("Setup", "H1") + p("Install it.") + f"<w:tbl><w:tr>{cell('Plan')}{cell('Price')}</w:tr><w:tr>{cell('Team')}{cell('')}</w:tr></w:tbl>" + p("Limits", "H1") + p("Ten seats.")
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})


def pptx():
    shape = lambda t, kind="body": f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda *s: f"<p:sld {P}><p:cSld><p:spTree>{''.join(s)}</p:spTree></p:cSld></p:sld>"
    rels = f'<Relationships><Relationship Id="r1" Type="{REL}/notesSlide" Target="../notesSlides/notesSlide1.xml"/></Relationships>'
    return zipped({"ppt/slides/slide1.xml": slide(shape("Title", "title"), shape("Body text")), "ppt/slides/slide2.xml": slide(), "ppt/slides/_rels/slide1.xml.rels": rels, "ppt/notesSlides/notesSlide1.xml": slide(shape("1", "sldNum"), shape("Say this"))})


def xlsx(n=3):
    row = lambda i, *cs: f'<row r="{i}">' + "".join(f'<c r="{chr(65 + k)}{i}" t="inlineStr"><is><t>{c}</t></is></c>' for k, c in enumerate(cs) if c is not None) + "</row>"
    rows = row(1, "Region", None, "Amount") + row(2, "EMEA", "x", "1200", "beyond") + row(3, "", "", "") + "".join(row(i, f"R{i}", None, str(i)) for i in range(4, 4 + n))
    book = f'<workbook {S_} {R}><sheets><sheet name="Sales" r:id="r1"/></sheets></workbook>'
    rels = f'<Relationships><Relationship Id="r1" Type="{REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'
    return zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": f"<worksheet {S_}><sheetData>{rows}</sheetData></worksheet>"})


HTML = "<html><head><style>x{}</style></head><body><p>Before</p><h1>Setup</h1><p>Install &amp; run<br>it</p><script>no()</script><h2>Limits</h2><li>one</li><li>two</li></body></html>"


def test_extractors():
    assert X.text_sections(b"intro\n# A\ntext\n\n#\nrest\n## \xff\n")[0] == [("intro", "body"), ("A\ntext", "A"), ("rest", "body"), ("�", "�")]
    assert X.html_sections(HTML)[0] == [("Before", "body"), ("Setup\nInstall & runit", "Setup"), ("Limits\none\ntwo", "Limits")]
    assert X.docx_sections(docx()) == ([("Intro line", "body"), ("Setup\nInstall it.", "Setup"), ("Limits\nTen seats.", "Limits"), ("Plan | Price\nTeam", "table 1")], {"tables": "1"})
    assert X.pptx_sections(pptx()) == ([("Title\nBody text\nSpeaker notes: Say this", "slide 1")], {"slides": "2"})
    found, meta = X.xlsx_sections(xlsx())
    assert found == [("Region: EMEA | col2: x | Amount: 1200\nRegion: R4 | Amount: 4\nRegion: R5 | Amount: 5\nRegion: R6 | Amount: 6", "sheet Sales")] and meta == {"sheets": "1"}
    found, meta = X.xlsx_sections(xlsx(2500))
    assert found[0][0].count("\n") == 1999 and meta["truncated_sheets"] == "Sales"
    assert X.row_lines([["a", "", "b"]]) == "a | b"
    assert X.supported_extensions() == [".docx", ".htm", ".html", ".md", ".pdf", ".pptx", ".rst", ".txt", ".xlsm", ".xlsx"]
    for bad in ("x.zip", "noextension", "a.b/c"):
        with pytest.raises(X.UnsupportedSourceError):
            X.extractor_for(bad)
    for name, content in (("a.docx", b"broken"), ("a.txt", b" \n"), ("a.pdf", b"%PDF")):
        with pytest.raises(X.ExtractionError):
            X.sections_of(name, content)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for name, content in {"handbook.md": HANDBOOK.encode(), "page.HTML": HTML.encode(), "a b+c.docx": docx(), "s.pptx": pptx(), "s.xlsx": xlsx(), "empty.txt": b"", "x.zip": b"zz", "bad.docx": b"no"}.items():
        (d / name).write_bytes(content)
    return str(d)


@pytest.fixture(scope="module")
def engine(spark, files, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("root")), Settings())
    e.results = {r["filename"]: r for r in e.ingest(files).collect()}
    return e


def asked(spark, *questions):
    return spark.createDataFrame([(str(i), q) for i, q in enumerate(questions)], "query_id string, question string")


def test_ingest(engine, spark, files):
    r = engine.results
    assert {n: x["status"] for n, x in r.items()} == {"handbook.md": 201, "page.HTML": 201, "a b+c.docx": 201, "s.pptx": 201, "s.xlsx": 201, "x.zip": 415, "bad.docx": 422}
    assert (r["handbook.md"]["sections"], r["handbook.md"]["chunks"], r["handbook.md"]["replaced_chunks"]) == (3, 3, 0)
    before = engine.stats()
    again = {x["filename"]: x["replaced_chunks"] for x in engine.ingest(f"{files}/handbook.md").collect()}
    assert again == {"handbook.md": 3} and engine.stats() == before
    assert before["documents"] == 5 and before["chunks"] == before["indexed_chunks"]
    assert [x["filename"] for x in engine.documents().collect()] == sorted(n for n, x in r.items() if x["status"] == 201)
    with pytest.raises(X.ExtractionError):
        engine.ingest("/nowhere/at/all.txt")


def test_size_limit(spark, files):
    big = X.extract(X.read_files(spark, f"{files}/handbook.md"), max_bytes=10).first()
    assert big["status"] == 413 and big["sections"] == []
    none = spark.createDataFrame([("/a/empty.txt", 0, bytearray())], "path string, length long, content binary")  # binaryFile lists no empty files
    assert X.extract(none).first()["status"] == 400


def test_delete_and_health(spark, files, tmp_path):
    e = Engine(spark, str(tmp_path / "root"))
    assert e.stats() == {"documents": 0, "chunks": 0, "indexed_chunks": 0} and e.delete("x") is None
    assert e.ask(asked(spark, "what documents are there")).first()["text"] == "No documents are indexed yet."
    assert e.ask(asked(spark, "how are seats billed")).first()["escalated"]
    e.ingest(f"{files}/handbook.md")
    key = e.documents().first()["doc_id"]
    e.ingest(f"{files}/handbook.md")
    e.compact()
    assert e.stats() == {"documents": 1, "chunks": 3, "indexed_chunks": 3} and e.log.read("chunks", "doc_id string").count() == 3
    assert e.get(key).count() == 1 and e.delete(key) == 3 and e.stats()["indexed_chunks"] == 0 and e.delete(key) is None
    e.ingest(f"{files}/handbook.md")
    assert e.stats()["indexed_chunks"] == 3
    assert e.health()["status"] == "ok" and e.metrics()["embedding_dimensions"] == 384


@pytest.mark.parametrize("mode", ["hybrid", "dense", "lexical"])
def test_search(engine, spark, mode):
    rows = engine.search(asked(spark, "reset the password"), mode, 2).orderBy("rank").collect()
    assert rows[0]["section_label"] == "Password reset" and [r["rank"] for r in rows] == [1, 2][: len(rows)]
    assert {r["method"] for r in rows} == {mode}


def test_search_limits(engine, spark):
    for bad in ({"mode": "other"}, {"limit": 0}, {"limit": 51}):
        with pytest.raises(ValueError):
            engine.search(asked(spark, "x"), **bad)
    with pytest.raises(ValueError):
        engine.search(asked(spark, ""))


def test_ask(engine, spark):
    q = ["how are seats billed when they change", "what is the airspeed of a swallow", "ERR_LOCK_TIMEOUT", "which documents are there", "  ", "who won the 1998 world cup", "capital of Peru"]
    r = {x["question"]: x for x in engine.ask(asked(spark, *q)).collect()}
    first = r[q[0]]
    assert first["grounded"] and "pro-rated" in first["text"] and first["citations"] == ["[handbook.md, Billing]"] and first["confidence"] == first["passages"][0]["score"]
    for i in (1, 5, 6):
        assert r[q[i]]["text"] == A.REFUSAL and r[q[i]]["escalated"] and r[q[i]]["citations"] == []
    assert (r[q[2]]["intent"], r[q[2]]["handler"], len(r[q[2]]["passages"])) == ("lookup", "exact-lookup", 2) and r[q[2]]["citations"] == ["[handbook.md, Troubleshooting]"]
    assert r[q[3]]["text"] == "5 document(s) indexed: a b+c.docx, handbook.md, page.HTML, s.pptx, s.xlsx" and r[q[3]]["grounded"]
    assert r[""]["escalated"] and r[""]["passages"] == []


def lists(spark, *ranked):
    return [spark.createDataFrame([("q", x, i, 1.0) for i, x in enumerate(r, 1)], "query_id string, id string, rank int, score double") for r in ranked]


def test_fusion(spark):
    got = S.fuse(lists(spark, "abc", "bca"), [1.0, 1.0], limit=5).orderBy("rank").collect()
    want = {x: sum(1 / (60 + r.index(x) + 1) for r in ("abc", "bca")) for x in "abc"}
    assert [r["id"] for r in got] == sorted(want, key=lambda x: -want[x]) and all(r["score"] == pytest.approx(want[r["id"]]) for r in got)
    assert [r["id"] for r in S.fuse(lists(spark, "ab", "cd"), [1.0, 1.0]).orderBy("rank").collect()] == ["a", "c", "b", "d"]
    assert S.fuse(lists(spark, "ab", "ca"), [1.0, 3.0]).orderBy("rank").first()["id"] == "a"
    with pytest.raises(ValueError):
        S.fuse(lists(spark, "ab"), [1.0, 1.0])


def index(spark, *texts):
    df = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "id string, tie int, text string")
    return S.with_terms(df)


def test_bm25(spark):
    texts = ["seat seats plan", "a plan", "other words entirely here"]
    got = {r["id"]: r["score"] for r in S.lexical(index(spark, *texts), asked(spark, "seats seat plans"), 5).collect()}
    mean, n = (3 + 2 + 4) / 3, 3
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, size, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))
    assert got == {"0": pytest.approx(2 * part(2, 3, 1) + part(1, 3, 2)), "1": pytest.approx(part(1, 2, 2))}
    assert S.lexical(index(spark, *texts), asked(spark, "zzz", ""), 5).count() == 0
    assert S.lexical(index(spark, *texts).where("false"), asked(spark, "seat"), 5).count() == 0


def test_dense(spark):
    v = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, [0.0, 0.0]), ("c", 3, [0.0, 2.0]), ("d", 4, [2.0, 0.0])], "id string, tie int, vector array<double>")
    q = spark.createDataFrame([("q", [3.0, 0.0]), ("zero", [0.0, 0.0])], "query_id string, vector array<double>")
    got = [(r["query_id"], r["id"], r["score"]) for r in S.dense(v, q, 3).orderBy("rank").collect()]
    assert got == [("q", "a", 1.0), ("q", "d", 1.0), ("q", "b", 0.0)]


def candidates(spark, question, *texts):
    return spark.createDataFrame([("q", question, str(i), t, 0.01, "hybrid", i) for i, t in enumerate(texts, 1)], "query_id string, question string, id string, text string, score double, method string, rank int")


def test_overlap_reranker(spark):
    c = candidates(spark, "reset the password", "nothing of it", "The password reset page", "reset the password here")
    got = OverlapReranker().rerank(c, 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["3", "2", "1"] and [r["score"] for r in got] == [pytest.approx(0.6 + 0.3 + 0.1 / 3), pytest.approx(0.6 + 0.3 / 2 + 0.05), 0.0]
    kept = OverlapReranker().rerank(candidates(spark, "what is it", "x", "y"), 1).collect()
    assert [(r["id"], r["score"], r["method"]) for r in kept] == [("1", 0.01, "hybrid")]
    assert NoReranker().rerank(c, 2).count() == 2
    loaded = CrossEncoderReranker(load=lambda: N(predict=lambda pairs: [len(t) for _, t in pairs]))
    assert [r["id"] for r in loaded.rerank(c, 2).orderBy("rank").collect()] == ["2", "3"]
    with pytest.raises(RuntimeError):
        CrossEncoderReranker()
    with pytest.raises(ValueError):
        build_reranker("other")
    with pytest.raises(ValueError):
        build_vector_store("other")


def client():
    """Stands in for a network client; imported by name on the workers, as a real factory would be."""
    return N(
        embeddings=N(create=lambda model, input, dimensions: N(data=[N(embedding=[float(len(t))] * dimensions) for t in input])),
        chat=N(completions=N(create=lambda model, temperature, messages: N(choices=[N(message=N(content="told " + messages[1]["content"][:9]))]))),
    )


def test_models_by_stub(spark):
    df = spark.createDataFrame([("a" * i,) for i in range(300)], "text string").coalesce(1)
    assert [r["vector"] for r in ModelEmbedder(2, client=client).embed(df).collect()] == [[float(i)] * 2 for i in range(300)]
    p = candidates(spark, "q?", "one", "two").withColumn("citation", F.lit("[c]"))
    assert A.build_llm("openai", client).complete(p).first()["completion"] == "told Context:\n"
    with pytest.raises(ValueError):
        A.build_llm("other")


def test_metrics(spark):
    ranks = spark.createDataFrame([("a", i, int(i == 3)) for i in range(1, 6)] + [("b", 1, 1)], "query_id string, rank int, hit int")
    q = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 0)], "query_id string, n_relevant int")
    got = {r["query_id"]: r for r in E.by_question(q, ranks).collect()}
    assert (got["a"]["p_at_5"], got["a"]["r_at_5"], got["a"]["mrr"], got["a"]["ndcg_at_10"]) == (0.2, 1.0, pytest.approx(1 / 3), 0.5)
    assert got["b"]["ndcg_at_10"] == pytest.approx(1 / (1 + 1 / math.log2(3))) and got["b"]["p_at_1"] == 1
    assert all(got[x][m] == 0 for x in "cd" for m in E.METRICS)
    assert E.retrieval_scores(q.where("false"), ranks).first().asDict() == {"questions": 0} | dict.fromkeys(E.METRICS, 0.0)
    r = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True)], "answerable boolean, escalated boolean")
    assert tuple(E.refusal_scores(r).first()) == (2, 2, 0.5, 0.5) and tuple(E.refusal_scores(r.where("false")).first()) == (0, 0, 0.0, 0.0)
    assert E.as_row("x", {"a": 0.12345, "n": 3}) == "| x | 0.123 | 3 |"
    with pytest.raises(E.IndexTooSmall):
        E.guard_index_size(10, 10)


def test_evaluate(engine, spark, tmp_path):
    body = {"questions": [{"id": "1", "question": "reset the password", "relevant": ["handbook.md#Password reset"]}, {"id": "2", "question": "capital of Peru", "relevant": []}]}
    (tmp_path / "q.json").write_text(json.dumps(body))
    q = load_questions(spark, str(tmp_path / "q.json"))
    assert engine.evaluate_refusal(q) == {"unanswerable": 1, "answerable": 1, "false_answer_rate": 0.0, "wrongly_refused_rate": 0.0}
    assert engine.evaluate(q)["lexical"]["p_at_1"] == 1.0
    body["questions"].append(body["questions"][0])
    (tmp_path / "twice.json").write_text(json.dumps(body))
    with pytest.raises(E.DatasetError):
        load_questions(spark, str(tmp_path / "twice.json"))
    with pytest.raises(E.DatasetError):
        E.validate(q, spark.createDataFrame([("other#x",)], "key string"))


def test_mutations(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, v int, x string")
    assert sorted(map(tuple, store.latest(old, ["k"], "v").collect())) == [(1, 2, "b"), (2, 1, "c")]
    new = spark.createDataFrame([(2, 9, "z"), (3, 9, "z")], "k int, v int, x string")
    assert sorted(map(tuple, store.upsert(old, new, ["k"]).collect())) == [(1, 1, "a"), (1, 2, "b"), (2, 9, "z"), (3, 9, "z")]


def test_failed_commit_leaves_all_tables(spark, tmp_path):
    t = store.Log(spark, str(tmp_path))
    assert t.commit({"x": spark.range(3)}) == 1
    with pytest.raises(Exception):  # noqa: B017
        t.commit({"y": spark.range(1), "x": spark.range(3).select(F.raise_error("no").cast("long").alias("id"))})
    assert t.read("x", "id long").count() == 3 and t.read("y", "id long").count() == 0
    assert t.commit({"x": spark.range(2)}) == 2 and t.read("x", "id long").count() == 5
    t.commit({"x": spark.range(1)}, replace=True)
    assert t.read("x", "id long").count() == 1


def test_watch(spark, files, tmp_path):
    from quernstone.streaming import watch

    e = Engine(spark, str(tmp_path / "root"))
    for _ in range(2):
        watch(spark, e, files, str(tmp_path / "cp")).awaitTermination()
        assert e.stats()["documents"] == 5
