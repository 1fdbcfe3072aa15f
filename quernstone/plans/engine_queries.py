"""Queries that run the engine itself over the test tables, and their SQL.

The engine ingests all documents, each a file with one section, into a folder of its own; the questions are the items of `benchmark`
and a few fixed ones for the other intents.  Each query calls the engine's own functions and returns what they give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.config import Settings
from quernstone.functions import text as T
from quernstone.operators import answer as A
from quernstone.operators import evaluate as E
from quernstone.operators import search as S
from quernstone.operators.ann import CellIndex, recall
from quernstone.operators.arrow import ROWS_IN_TASK, attach, spread
from quernstone.operators.embed import HashingEmbedder
from quernstone.operators.store import Log
from quernstone.operators.vectors import TableStore
from quernstone.sources import office
from quernstone.sources.extract import DOCUMENT, extract, row_lines
from quernstone.staging import Stage, near

from . import catalogue as C
from .engine import RERANK_DEPTH, VARIANTS, Engine

#: Questions for the intents that the items don't have, and one that nothing answers.
ASKED = ((-1, "Which documents are there?"), (-2, "Give me a summary of the and of"), (-3, "xyzzy plugh frobnicate"), (-4, "   "))
LIMIT = 6
#: The floors of the published sweep.
SWEEP = [0.10, 0.15, 0.20, 0.25, 0.35, 0.60]
_engines: dict[tuple, Engine] = {}


def _files(spark: SparkSession, d: str, text: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """The documents as DOCUMENT rows."""
    one = F.array(F.struct(text(F.col("text")).alias("text"), F.lit("body").alias("label"), F.lit(0).alias("ordinal")))
    name = F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt"))
    none = F.create_map().cast("map<string,string>")
    rows = C._table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), name.alias("filename"), F.lit("text").alias("source_type"), one.alias("sections"), none.alias("metadata"), F.lit(None).cast("string").alias("error"), F.lit(201).alias("status"))
    return rows.select(*(c.split()[0] for c in DOCUMENT.replace(f"sections {C.SECTION}", "sections").split(", ")))


def _new(spark: SparkSession) -> Engine:
    stage = Stage(spark)
    stage.append(spark.range(0), "engine")
    return Engine(spark, f"{stage.root}/root")


def _state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """How many files a table has, their bytes, and when the newest was written."""
    files = spark.read.parquet(path).groupBy("_metadata.file_path").agg(F.max("_metadata.file_size").alias("size"), F.max(F.unix_micros("_metadata.file_modification_time")).alias("at"))
    return tuple(files.agg(F.count("*"), F.sum("size"), F.max("at")).first())


def _engine(spark: SparkSession, d: str) -> Engine:
    """An engine that holds all documents; one for each application, folder and state of its files, which no query changes."""
    key = (spark.sparkContext.applicationId, d, *_state(spark, f"{d}/documents.parquet"))
    if key not in _engines:
        engine = _new(spark)
        engine.ingest_documents(_files(spark, d))
        _engines[key] = engine
    return _engines[key]


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return C._questions(spark, d).unionByName(spark.createDataFrame([(str(i), q) for i, q in ASKED], "query_id string, question string"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Items with the sections of the documents that hold their text; none: unanswerable."""
    items = C._questions(spark, d)
    docs = _files(spark, d).select(T.section_key(F.col("filename"), F.lit("body")).alias("key"), F.col("sections")[0]["text"].alias("text"))
    words = F.array_distinct(T.tokens(F.col("question")))
    rare = items.select("query_id", "question", F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("word"))
    # words are met without the texts, which would be repeated for each of them
    met = docs.select("key", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).join(F.broadcast(rare), "word").select("key", "query_id", "question")
    held = near(Stage(spark).keep(met, "met")).join(docs, "key").where(F.contains("text", "question"))
    found = held.groupBy("query_id").agg(F.array_sort(F.collect_set("key")).alias("relevant"))
    return items.join(found, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<string>")))


def engine_ingest(spark, d):
    return _new(spark).ingest_documents(_files(spark, d)).drop("error")


def engine_chunks(spark, d):
    c = _engine(spark, d).chunks()
    return c.select("chunk_id", "doc_id", "filename", "section_label", "ordinal", F.md5("text").alias("text_md5"), "len", F.size("terms").alias("n_terms"))


def engine_documents(spark, d):
    return _engine(spark, d).documents().drop("ingested_at")


def engine_get(spark, d):
    e = _engine(spark, d)
    rows = [e.get(str(i)) for i in (0, 7, -1)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("doc_id", "filename", "chunk_count")


def engine_stats(spark, d):
    e = _engine(spark, d)
    m, h = e.metrics(), e.health()
    row = (*e.stats().values(), m["documents"], m["indexed_chunks"], m["embedding_dimensions"], ",".join(m["supported_extensions"]), h["status"], h["vector_backend"], h["embedder"], h["reranker"], h["llm"])
    names = "documents long, chunks long, indexed_chunks long, m_documents long, m_indexed_chunks long, embedding_dimensions long, extensions string, status string, vector_backend string, embedder string, reranker string, llm string"
    return spark.createDataFrame([row], names)


def engine_reingest(spark, d):
    """The same documents again, the toxic ones with another text: what is left is one version of each."""
    e = _new(spark)
    e.ingest_documents(_files(spark, d))
    toxic = C._table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    again = e.ingest_documents(_files(spark, d, T.upper).join(toxic, "doc_id", "left_semi")).select("doc_id", "replaced_chunks")
    new = e.chunks().groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.when(F.col("text") == T.upper(F.col("text")), 1).otherwise(0)).alias("upper_chunks"))
    return new.join(again, "doc_id", "left")


def engine_delete(spark, d):
    """Some documents deleted, one that isn't there too: what each took, and what is left in both tables."""
    e = _new(spark)
    e.ingest_documents(_files(spark, d))
    gone = [(str(i), e.delete(str(i))) for i in (1, 3, 5, 999_999_999)]
    e.compact()
    s = e.stats()
    return spark.createDataFrame([(*g, s["documents"], s["chunks"], s["indexed_chunks"]) for g in gone], "doc_id string, removed long, documents long, chunks long, indexed_chunks long")


def _found(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("query_id").cast("long").alias("query_id"), "filename", "section_label", "citation", F.md5("text").alias("text_md5"), "score", "method", F.col("rank").cast("int").alias("rank"))


def engine_search_dense(spark, d):
    return _found(_engine(spark, d).search(C._questions(spark, d), "dense", LIMIT))


def engine_search_lexical(spark, d):
    return _found(_engine(spark, d).search(C._questions(spark, d), "lexical", LIMIT))


def engine_search_hybrid(spark, d):
    return _found(_engine(spark, d).search(C._questions(spark, d), "hybrid", LIMIT))


def engine_ask(spark, d):
    a = _engine(spark, d).ask(_asked(spark, d))
    return a.select(F.col("query_id").cast("long").alias("query_id"), "text", "grounded", "escalated", "confidence", F.array_join("citations", ";").alias("citations"), F.size("passages").alias("n_passages"), "intent", "handler")


def engine_rankings(spark, d):
    r = _engine(spark, d).rankings(C._questions(spark, d))
    keys = _engine(spark, d).chunks().select(F.col("chunk_id").alias("id"), T.section_key(F.col("filename"), F.col("section_label")).alias("key"), "ordinal")
    return near(r).join(keys, "id").select("variant", F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("int").alias("rank"), "key", "ordinal")


def engine_evaluate(spark, d):
    scores = _engine(spark, d).evaluate(_labelled(spark, d))
    return spark.createDataFrame([(v, s["questions"], *(round(s[m], 6) for m in E.METRICS)) for v, s in scores.items()], "variant string, questions long, " + ", ".join(f"{m} double" for m in E.METRICS))


def engine_refusal(spark, d):
    s = _engine(spark, d).evaluate_refusal(_labelled(spark, d))
    return spark.createDataFrame([(s["unanswerable"], s["answerable"], round(s["false_answer_rate"], 6), round(s["wrongly_refused_rate"], 6))], "unanswerable long, answerable long, false_answer_rate double, wrongly_refused_rate double")


def refusal_curve(spark, d):
    """Both refusal rates at every floor: the score is a query vector's best cosine, and it is answerable where that one has its label."""
    labels = C._vectors(spark, d).select(F.col("vec_id").cast("string").alias("key"), "label")
    asked = labels.select(F.col("key").alias("query_id"), F.col("label").alias("asked"))
    best = C._cosine(spark, d).where("rank = 2").join(asked, "query_id").join(labels, F.col("id") == F.col("key"))  # the first is itself
    rows = best.select((F.col("label") == F.col("asked")).alias("answerable"), "score", F.lit(False).alias("refused"))
    curve = E.refusal_curve(rows, 3)
    return curve.select("floor", "unanswerable", "answerable", F.round("false_answer_rate", 9).alias("false_answer_rate"), F.round("wrongly_refused_rate", 9).alias("wrongly_refused_rate"))


def ann_recall(spark, d):
    """The approximate search against the exact one, for every hundredth vector over all: whether it finds nine in ten of the ten nearest."""
    v = C._vectors(spark, d).select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("tie"), "vector")
    q = v.where("tie % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    stage = Stage(spark)
    stage.append(spark.range(0), "ann")
    index = CellIndex.build(v, f"{stage.root}/index")
    cells = len(index.quantiser.centres)
    found = index.search(v, q, 10, probes=max(8, cells // 2), keep=200)
    return recall(found, S.dense(v, q, 10)).select("questions", "wanted", (F.col("recall") >= 0.9).alias("nine_in_ten"))


def engine_refusal_sweep(spark, d):
    """Both refusal rates at each published floor, from answering the questions once."""
    out = _engine(spark, d).refusal_sweep(_labelled(spark, d), SWEEP)
    return out.select("floor", "unanswerable", "answerable", F.round("false_answer_rate", 6).alias("false_answer_rate"), F.round("wrongly_refused_rate", 6).alias("wrongly_refused_rate"))


def extract_files(spark, d):
    """All documents as files of several names, some again under names that have no extractor, and empty files: what is read, what is refused and why."""
    ext = F.element_at(F.array(*map(F.lit, (".md", ".txt", ".rst", ".MD"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = C._documents(spark, d)
    path = lambda start, end: F.concat(F.lit(f"file:/x/{start}"), F.col("doc_id").cast("string"), end).alias("path")
    text = F.col("text").cast("binary").alias("content")
    files = docs.select(path("f", ext), text)
    files = files.unionByName(docs.where("doc_id % 7 = 0").select(path("g", F.lit(".csv")), text)).unionByName(docs.where("doc_id % 7 = 1").select(path("h", F.lit("")), text))
    files = files.unionByName(docs.where("doc_id % 11 = 0").select(path("e", F.lit(".txt")), F.lit(b"").alias("content")))
    out = extract(files.select("path", F.octet_length("content").cast("long").alias("length"), "content"), Settings().max_upload_mb << 20)
    return out.select("doc_id", "filename", "source_type", "status", F.size("sections").alias("n_sections"), F.md5(F.concat_ws("\x1f", F.transform("sections", lambda s: F.concat(s["label"], F.lit("\x1e"), s["text"])))).alias("sections_md5"))


def office_files(spark, d):
    """All suppliers as DOCX, all parts as PPTX and all orders as XLSX files, a workbook for each hundred order keys, read back: a row a section.

    A file is a millisecond's work for a few bytes of a table, so rows are dealt to tasks by their number.
    """
    import pyarrow as pa

    content = [("content", "binary", pa.binary())]
    path = lambda key, end: F.concat(F.lit("file:/x/"), F.lit(end[0]), F.col(key).cast("string"), F.lit(f".{end}")).alias("path")
    s = C._table(spark, d, "supplier").select(path("s_suppkey", "docx"), "s_suppkey", "s_name", "s_nationkey")
    s = attach(spread(s), ["s_suppkey", "s_name", "s_nationkey"], content, lambda *c: [[office.docx([(None, [f"About <{k}> & others", " "]), (n, [f"Nation {a}"])], [[["key", "nation"], ["", ""], [str(k), str(a)]]]) for k, n, a in zip(*c, strict=True)]])
    p = C._table(spark, d, "part").select(path("p_partkey", "pptx"), "p_name", "p_type", "p_brand", "p_size")
    p = attach(spread(p), ["p_name", "p_type", "p_brand", "p_size"], content, lambda *c: [[office.pptx([([n, t], b), ([f"Size {z}"] if z % 2 else [], None), (["Last"], None)]) for n, t, b, z in zip(*c, strict=True)]])
    # order keys are unique, so a workbook has at most a hundred rows
    o = C._table(spark, d, "orders").withColumn("book", F.expr("o_orderkey div 100"))
    o = spread(o, "book", rows=32 * ROWS_IN_TASK).groupBy("book").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("rows")).select(path("book", "xlsx"), "rows")
    head = ["order", None, "priority"]
    o = attach(o, ["rows"], content, lambda rs: [[office.xlsx("Orders", [head, *((r["o_orderkey"], r["o_orderstatus"] if r["o_orderkey"] % 3 else None, r["o_orderpriority"], "beyond") for r in x)]) for x in rs]])
    files = s.select("path", "content").unionByName(p.select("path", "content")).unionByName(o.select("path", "content"))
    out = extract(files.select("path", F.octet_length("content").cast("long").alias("length"), "content"), Settings().max_upload_mb << 20)
    return out.select("filename", "source_type", "status", F.inline("sections")).select("filename", "source_type", "status", "label", "ordinal", "text")


def _customer_lines(spark, d):
    """Each customer as a row under the sheets' header, by the rule that gives a sheet's lines: blank values skipped, columns without a header named, cells beyond the header dropped."""
    import pyarrow as pa

    header = F.array(F.lit("name"), F.lit(""), F.lit("key"))
    cells = F.array(F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment")), F.col("c_custkey").cast("string"), F.lit("beyond"))
    rows = C._table(spark, d, "customer").select("c_nationkey", "c_custkey", F.array(header, cells).alias("rows"))
    return attach(rows, ["rows"], [("line", "string", pa.string())], lambda rs: [[row_lines(r) for r in rs]]).select("c_nationkey", "c_custkey", "line")


def sheet_lines(spark, d):
    """Customers of each nation as a sheet under one header: the digest and length of its whole text.

    The lines are made batch by batch, each under the header; a nation's text is its lines in order.
    """
    lines = _customer_lines(spark, d).where("line <> ''")
    sheets = lines.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return sheets.select("c_nationkey", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def sheet_rows(spark, d):
    """The lines of those sheets themselves, a row a customer; empty where there is nothing to show."""
    return _customer_lines(spark, d)


def vector_store(spark, d):
    """Chunks of the vector table put in twice, one document deleted: count, ids, payload defaults and the nearest of some."""
    stage = Stage(spark)
    stage.append(spark.range(0), "store")
    store = TableStore(Log(spark, f"{stage.root}/root"), 64)
    v = C._table(spark, d, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("chunk_id"), F.col("label").cast("string").alias("doc_id"), F.concat(F.lit("t"), "vec_id").alias("text"), F.col("embedding").alias("vector"))
    store.upsert(v)
    store.upsert(v.where("chunk_id like '%5'").withColumns({"filename": F.lit("again"), "ordinal": F.lit(3)}))
    gone = store.delete_document("1")
    left = store.all_chunks()
    q = v.where("chunk_id like 'c%00'").select(F.col("chunk_id").alias("query_id"), "vector")
    near = store.search(q, 3).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("near"))
    rows = left.join(near, left["chunk_id"] == near["query_id"], "left")
    return rows.select("point_id", "chunk_id", "doc_id", "filename", "section_label", "ordinal", "text", "near", F.lit(gone).cast("long").alias("gone"), F.lit(store.count()).cast("long").alias("n"))


def queries() -> dict:
    found = (
        engine_ingest, engine_chunks, engine_documents, engine_get, engine_stats, engine_reingest, engine_delete, engine_search_dense, engine_search_lexical, engine_search_hybrid, engine_ask, engine_rankings, engine_evaluate, engine_refusal,
        ann_recall, refusal_curve, engine_refusal_sweep, extract_files, office_files, sheet_lines, sheet_rows, vector_store,
    )
    return {f.__name__: f for f in found}


# -- the same in SQL ---------------------------------------------------------------------------------------------------------------

STRIP = r"regexp_replace({x}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"
WINDOW_MARK = "chr(2)"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


def chunk_sql(source: str, max_chars: int = 1200, overlap: int = 150, least: int = 80) -> str:
    """CTEs that end in chunk0(doc_id, filename, label, ordinal, body) from source(doc_id, filename, label, text); texts without a blank line.

    Sentences are packed by a fold over one-element lists; a sentence over the limit gives windows, marked so that nothing is packed with them.
    """
    glue = "case when left(x[1], 1) = chr(2) or left(acc[len(acc)], 1) = chr(2) or length(acc[len(acc)]) + 1 + length(x[1]) > {m} then list_concat(acc, x) else list_concat(acc[1:len(acc) - 1], [acc[len(acc)] || {g} || x[1]]) end"
    pack = glue.format(m=max_chars, g="' '")
    merge = f"case when length(acc[len(acc)]) + 1 + length(x[1]) > {max_chars} then list_concat(acc, x) else list_concat(acc[1:len(acc) - 1], [acc[len(acc)] || chr(10) || x[1]]) end"
    return f"""
src as (select doc_id, filename, label, {_strip('text')} as t from ({source})),
parts as (select *, case when length(t) <= {max_chars} then [t] else flatten(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
   lambda x: case when length(x) <= {max_chars} then [x] else list_transform(range(0, cast(ceil(length(x) / {max_chars}) as bigint)), lambda i: {WINDOW_MARK} || substr(x, cast(i * {max_chars} + 1 as bigint), {max_chars})) end)) end as e from src),
packs as (select * exclude (e), case when length(t) <= {max_chars} then e else list_filter(list_transform(list_reduce(list_transform(e, lambda x: [x]), lambda acc, x: {pack}), lambda p: replace(p, {WINDOW_MARK}, '')), lambda p: p <> '') end as p from parts),
merged as (select * exclude (p), case when len(p) = 0 then [left(t, {max_chars})] else list_reduce(list_transform(p, lambda x: [x]), lambda acc, x: {merge}) end as m from packs),
laid as (select doc_id, filename, label, m, unnest(range(1, len(m) + 1)) as i from merged),
body as (select doc_id, filename, label, i, len(m) as n, case when i = 1 then m[i] else {_strip(f"right(m[i - 1], {overlap}) || chr(10) || m[i]")} end as body from laid),
chunk0 as (select doc_id, filename, label, cast(row_number() over (partition by doc_id order by i) - 1 as integer) as ordinal, body from body where length(body) >= {least} or n = 1 or i = 1)"""


NAME = "'doc' || lpad(cast(doc_id as varchar), 12, '0') || '.txt'"
FILES = f"select cast(doc_id as varchar) as doc_id, {NAME} as filename, 'body' as label, text from documents"
CHUNK_ID = "left(sha256(doc_id || ' ' || label || ' ' || ordinal || ' ' || left(body, 64)), 32)"
#: Chunks under the names that the catalogue's SQL has for documents: doc_id is the key by which ties go.
BASE = f"""{chunk_sql(FILES)},
chunk as materialized (select filename || chr(31) || ordinal_key as doc_id, body as text, filename, label, ordinal from (select *, doc_id || chr(31) || lpad(cast(ordinal as varchar), 9, '0') as ordinal_key from chunk0))"""


def _over_chunks(sql: str) -> str:
    return sql.replace("from documents d", "from chunk d").replace("from documents)", "from chunk)").replace("from documents", "from chunk").replace("join documents d", "join chunk d")


BM25, DENSE = _over_chunks(C.BM25), _over_chunks(C.DENSE)
QUESTIONS = "select item_id, text from benchmark"


def _lists(depth: int = 12) -> str:
    return f"""lists as (select query_id, doc_id, rank, 0 as list from dense where rank <= {depth} union all select query_id, doc_id, rank, 1 from lexical where rank <= {depth}),
fused as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 12) as score, min(struct_pack(a := list, b := rank)) as seen from lists group by all),
hybrid as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, seen) as rank from fused)"""


def _reranked(depth: int, asked: str) -> str:
    return f"""cand as (select query_id, doc_id, rank, lower(d.text) as low, {C._content('b.text')} as q, {C._content('d.text')} as p, {C._tok('b.text')} as qt
  from hybrid join chunk d using (doc_id) join {asked} b on b.item_id = query_id where rank <= {depth}),
gram as (select *, list_distinct(list_transform(range(1, len(qt)), lambda i: qt[i] || ' ' || qt[i + 1])) as pairs, len(list_intersect(q, p)) as common from cand),
over as (select query_id, doc_id, rank as was, round(case when common = 0 then 0 else 0.6 * common / len(q) +
  case when len(pairs) = 0 then 0 else 0.3 * len(list_filter(pairs, lambda x: contains(low, x))) / len(pairs) end + 0.1 / rank end, 12) as score from gram),
reranked as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, was) as rank from over)"""


def _hits(table: str, method: str) -> str:
    return f"""select cast(query_id as bigint) as query_id, filename, label as section_label, '[' || filename || ', ' || label || ']' as citation, md5(text) as text_md5, round(score, 4) as score, '{method}' as method, cast(rank as integer) as rank
      from {table} join chunk using (doc_id) where rank <= {LIMIT}"""


INTENT = r"""case when regexp_matches(text, '(?i)\b(what (documents|files|sources)|which documents|list (the )?(documents|files)|what do you (have|know))\b') then 'inventory'
  when regexp_matches(text, '(?i)\b(summar(y|ise|ize)|overview|tl;?dr|key points|main points)\b') then 'summarise'
  when regexp_matches(text, '\b([A-Z][A-Z0-9_]{4,}|error code|sku|invoice \d+)\b') then 'lookup' else 'answer' end"""


def _ask(questions: str) -> str:
    """CTEs that end in told(item_id, text, grounded, escalated, confidence, citations, n_passages, intent)."""
    return f"""{BASE},
question as (select item_id, {_strip('text')} as text, {INTENT} as intent from ({questions})),
sought as (select * from question where intent <> 'inventory' and text <> ''),
{BM25.replace('benchmark', 'sought')}, {DENSE.replace('benchmark', 'sought')}, {_lists()}, {_reranked(12, 'sought')},
passage as (select query_id, rank, score, d.text, '[' || d.filename || ', ' || d.label || ']' as cite, b.text as question from reranked join chunk d using (doc_id) join sought b on b.item_id = query_id
  where rank <= case intent when 'lookup' then 2 when 'summarise' then 8 else 4 end),
sentence as (
  select query_id, rank, pos, s, len(list_intersect(list_distinct({C._tok('s')}), {C._tok('question')})) as common from (
    select query_id, rank, question, pos, trim(regexp_replace(parts[pos], '\\s+', ' ', 'g')) as s from (
      select *, unnest(range(1, len(parts) + 1)) as pos from (select query_id, rank, question, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as parts from passage)))
  where length(s) >= 20),
best as (select query_id, s, min(struct_pack(a := -round(common + 1 / rank, 12), b := rank, c := pos)) as first_at from sentence where common > 0 group by all),
completion as (select query_id, string_agg(s, ' ' order by n) as completion from (select *, row_number() over (partition by query_id order by first_at) as n from best) where n <= 3 group by query_id),
used as (select query_id, rank, cite, len(list_filter(list_slice(string_split(text, '. '), 1, 4), lambda x: x <> '' and contains(completion, x))) > 0 as used from passage join completion using (query_id)),
seen as (select query_id, cite, min(rank) as rank from used where used group by all),
named as (select query_id, coalesce((select string_agg(cite, ';' order by rank) from seen where seen.query_id = used.query_id), arg_min(cite, rank)) as cites from used group by query_id),
best_of as (select query_id, arg_min(score, rank) as best, count(*) as n from passage group by query_id),
stock as (select count(*) || ' document(s) indexed: ' || string_agg(filename, ', ' order by filename) as stock from (select distinct doc_id, filename from src)),
told as (select item_id, intent, coalesce(n, 0) as n_passages, round(coalesce(best, 0), 4) as confidence, intent <> 'inventory' and (coalesce(best, 0) < 0.15 or completion is null) as escalated,
  case when intent = 'inventory' then stock when coalesce(best, 0) < 0.15 or completion is null then '{A.REFUSAL}' else completion end as text,
  case when intent = 'inventory' or coalesce(best, 0) < 0.15 or completion is null then '' else cites end as citations
  from question left join best_of on item_id = best_of.query_id left join completion on item_id = completion.query_id left join named on item_id = named.query_id cross join stock)"""


LABELLED = f"""label as (select item_id as query_id, coalesce(list_sort(list_distinct(list(f.filename || '#body') filter (f.filename is not null))), []) as relevant
  from benchmark b left join ({FILES}) f on contains(f.text, b.text) group by item_id)"""
FOUR = f"""ranked as (select '{VARIANTS[0]}' as variant, query_id, doc_id, rank from dense where rank <= 10 union all select '{VARIANTS[1]}', query_id, doc_id, rank from lexical where rank <= 10
  union all select '{VARIANTS[2]}', query_id, doc_id, rank from hybrid where rank <= 10 union all select '{VARIANTS[3]}', query_id, doc_id, rank from reranked where rank <= 10)"""


def text_sections_sql(source: str) -> str:
    """CTEs that end in section(id, section, label, text) from source(id, text): lines that start with # begin a section that they name."""
    name = _strip("ltrim(line, '#')")
    return f"""line as (select id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as pos from ({source})),
numbered as (select *, sum(case when line[1] = '#' then 1 else 0 end) over (partition by id order by pos) as section from line),
section as (select * from (select id, section, coalesce(nullif(max(case when line[1] = '#' then {name} end), ''), 'body') as label,
  {_strip(f"string_agg(case when line[1] = '#' then {name} else line end, chr(10) order by pos)")} as text from numbered group by id, section) where text <> '')"""


def _page_text(x: str) -> str:
    """Visible text of a stretch of the test pages: no tag inside a text node, four entities."""
    x = f"regexp_replace(regexp_replace({x}, '>\\s+<', '><', 'g'), '</(p|li|div|section|tr|br)>', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '[ \\t\\r\\f\\v]+', ' ', 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def _page_lines(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda s: {_strip('s')}), lambda s: s <> ''), chr(10))"


PAGES = f"""page as (select page_id, regexp_replace(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '', 'gs'), '<!--.*?-->', '', 'gs') as h from pages),
piece as (select page_id, unnest(string_split(h, '<h1>')) as h, unnest(range(0, len(string_split(h, '<h1>')))) as n from page),
named as (select *, case when n > 0 and contains(h, '</h1>') then {_strip(_page_text("string_split(h, '</h1>')[1]"))} end as name from piece),
told as (select page_id, n, name, {_page_lines("coalesce(name || chr(10), '') || " + _page_text("case when name is null then h else substr(h, strpos(h, '</h1>') + 5) end"))} as text from named)"""


def oracle_sql() -> dict:
    search = f"with {BASE}, {BM25}, {DENSE}, {_lists()}"
    four = f"{search}, {_reranked(RERANK_DEPTH, 'benchmark')}, {FOUR}"
    asked = f"{QUESTIONS} union all select * from (values " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ")"
    counts = f"with {chunk_sql(FILES)}, n as (select doc_id, filename, count(*) as n from chunk0 group by all)"
    upper = f"select cast(doc_id as varchar) as doc_id, {NAME} as filename, 'body' as label, case when doc_id in (select doc_id from labels where toxic = 1) then upper(text) else text end as text from documents"
    gain = "sum(case when hit then 1 / log2(rank + 1) else 0 end)"
    ext = "case doc_id % 4 when 0 then '.md' when 1 then '.txt' when 2 then '.rst' else '.MD' end"
    return {
        "office_files": """with d as (select 'd' || s_suppkey || '.docx' as filename, 'docx' as source_type, unnest(['body', s_name, 'table 1']) as label, unnest([0, 1, 2]) as ordinal,
            unnest(['About <' || s_suppkey || '> & others', s_name || chr(10) || 'Nation ' || s_nationkey, 'key | nation' || chr(10) || s_suppkey || ' | ' || s_nationkey]) as text from supplier),
          p as (select 'p' || p_partkey || '.pptx' as filename, 'pptx' as source_type, unnest(case when p_size % 2 = 1 then ['slide 1', 'slide 2', 'slide 3'] else ['slide 1', 'slide 3'] end) as label, unnest(case when p_size % 2 = 1 then [0, 1, 2] else [0, 1] end) as ordinal,
            unnest(list_filter([p_name || chr(10) || p_type || chr(10) || 'Speaker notes: ' || p_brand, case when p_size % 2 = 1 then 'Size ' || p_size end, 'Last'], lambda x: x is not null)) as text from part),
          o as (select 'x' || (o_orderkey // 100) || '.xlsx' as filename, 'xlsx' as source_type, 'sheet Orders' as label, 0 as ordinal,
            string_agg('order: ' || o_orderkey || case when o_orderkey % 3 <> 0 then ' | col2: ' || o_orderstatus else '' end || ' | priority: ' || o_orderpriority, chr(10) order by o_orderkey) as text from orders group by o_orderkey // 100)
          select filename, source_type, 201 as status, label, ordinal, text from (select * from d union all select * from p union all select * from o)""",
        "engine_ingest": f"{counts} select doc_id, filename, 'text' as source_type, 1 as sections, cast(n as integer) as chunks, cast(0 as bigint) as replaced_chunks, 201 as status from n",
        "engine_chunks": f"""with {chunk_sql(FILES)}, t as (select *, list_transform({C._tok('body')}, lambda t: {C.STEM.format(t='t')}) as ts from chunk0)
          select {CHUNK_ID} as chunk_id, doc_id, filename, label as section_label, ordinal, md5(body) as text_md5, cast(len(ts) as bigint) as len, cast(len(list_distinct(ts)) as integer) as n_terms from t""",
        "engine_documents": f"{counts} select doc_id, filename, 'text' as source_type, 1 as section_count, cast(n as integer) as chunk_count from n",
        "engine_get": f"{counts} select doc_id, filename, cast(n as integer) as chunk_count from n where doc_id in ('0', '7', '-1')",
        "engine_stats": f"""{counts} select count(*) as documents, cast(sum(n) as bigint) as chunks, cast(sum(n) as bigint) as indexed_chunks, count(*) as m_documents, cast(sum(n) as bigint) as m_indexed_chunks, cast(384 as bigint) as embedding_dimensions,
          '.docx,.htm,.html,.md,.pdf,.pptx,.rst,.txt,.xlsm,.xlsx' as extensions, 'ok' as status, 'memory' as vector_backend, 'hashing' as embedder, 'lexical-overlap' as reranker, 'extractive' as llm from n""",
        "engine_reingest": f"""with {chunk_sql(upper)}, o as (select doc_id, count(*) as n from (with {chunk_sql(FILES)} select * from chunk0) group by doc_id)
          select doc_id, count(*) as chunks, cast(sum(case when body = upper(body) then 1 else 0 end) as bigint) as upper_chunks,
            max(case when cast(doc_id as bigint) in (select doc_id from labels where toxic = 1) then n end) as replaced_chunks from chunk0 join o using (doc_id) group by doc_id""",
        "engine_delete": f"""{counts}, picked as (select * from n), left_over as (select * from picked where doc_id not in ('1', '3', '5'))
          select g.doc_id, picked.n as removed, (select count(*) from left_over) as documents, cast((select sum(n) from left_over) as bigint) as chunks, cast((select sum(n) from left_over) as bigint) as indexed_chunks
          from (values ('1'), ('3'), ('5'), ('999999999')) g(doc_id) left join picked using (doc_id)""",
        "engine_search_dense": f"with {BASE}, {DENSE} {_hits('dense', 'dense')}",
        "engine_search_lexical": f"with {BASE}, {BM25} {_hits('lexical', 'lexical')}",
        "engine_search_hybrid": f"{search} {_hits('hybrid', 'hybrid')}",
        "engine_ask": f"""with {_ask(asked)} select cast(item_id as bigint) as query_id, text, not escalated as grounded, escalated, confidence, citations, cast(n_passages as integer) as n_passages, intent,
          case intent when 'answer' then 'grounded-answer' when 'lookup' then 'exact-lookup' when 'summarise' then 'summariser' else 'inventory' end as handler from told""",
        "engine_rankings": f"{four} select variant, cast(query_id as bigint) as query_id, cast(rank as integer) as rank, filename || '#' || label as key, ordinal from ranked join chunk using (doc_id)",
        "engine_evaluate": f"""{four}, {LABELLED}, sure as (select * from label where len(relevant) > 0),
          h as (select variant, query_id, rank, list_contains(relevant, filename || '#' || label) as hit, len(relevant) as n from ranked join chunk using (doc_id) join sure using (query_id)),
          q as (select variant, query_id, any_value(n) as n, count(*) filter (hit and rank <= 1) as h1, count(*) filter (hit and rank <= 5) as h5, count(*) filter (hit) as h10, max(case when hit then 1 / rank else 0 end) as rr, {gain} as g from h group by all),
          v as (select unnest({list(VARIANTS)}) as variant), o as (select v.variant, sure.query_id, len(relevant) as n, coalesce(h1, 0) as h1, coalesce(h5, 0) as h5, coalesce(h10, 0) as h10, coalesce(rr, 0) as rr, coalesce(g, 0) as g
            from v cross join sure left join q on q.variant = v.variant and q.query_id = sure.query_id)
          select variant, count(*) as questions, round(avg(h1), 6) as p_at_1, round(avg(h5 / 5), 6) as p_at_5, round(avg(h5 / n), 6) as r_at_5, round(avg(h10 / n), 6) as r_at_10, round(avg(rr), 6) as mrr,
            round(avg(g / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1)))), 6) as ndcg_at_10 from o group by variant""",
        "engine_refusal": f"""with {_ask(QUESTIONS)}, {LABELLED}, j as (select len(relevant) > 0 as yes, escalated from told join label on item_id = label.query_id)
          select count(*) filter (not yes) as unanswerable, count(*) filter (yes) as answerable, round(coalesce(avg(case when escalated then 0.0 else 1.0 end) filter (not yes), 0), 6)::double as false_answer_rate,
            round(coalesce(avg(case when escalated then 1.0 else 0.0 end) filter (yes), 0), 6)::double as wrongly_refused_rate from j""",
        "ann_recall": """with q as (select vec_id from embeddings where vec_id % 100 = 0), n as (select count(*) as n from embeddings)
          select (select count(*) from q) as questions, (select count(*) from q) * least(10, (select n from n)) as wanted, true as nine_in_ten""",
        "refusal_curve": f"""with {C.COSINE}, b as (select round(score, 3) as floor, label = asked as yes from cosine where rank = 2),
          g as (select floor, count(*) filter (yes) as y, count(*) filter (not yes) as n from b group by floor),
          w as (select floor, sum(y) over () as all_y, sum(n) over () as all_n, coalesce(sum(y) over before, 0) as ref_y, coalesce(sum(n) over before, 0) as ref_n from g window before as (order by floor rows between unbounded preceding and 1 preceding))
          select floor, cast(all_n as bigint) as unanswerable, cast(all_y as bigint) as answerable, round(case when all_n > 0 then (all_n - ref_n) / all_n else 0 end, 9) as false_answer_rate,
            round(case when all_y > 0 then ref_y / all_y else 0 end, 9) as wrongly_refused_rate from w""",
        "engine_refusal_sweep": f"""with {_ask(QUESTIONS).replace('< 0.15', '< -1')}, {LABELLED}, top as (select query_id, max(score) filter (rank = 1) as top from passage group by query_id),
          j as (select len(relevant) > 0 as yes, intent = 'inventory' as listed, escalated, top from told join label on item_id = label.query_id left join top on top.query_id = item_id),
          f as (select unnest({SWEEP}::double[]) as floor), e as (select floor, yes, case when listed then escalated else escalated or top is null or top < floor end as up from j, f)
          select floor, count(*) filter (not yes) as unanswerable, count(*) filter (yes) as answerable, round(coalesce(avg(case when up then 0.0 else 1.0 end) filter (not yes), 0), 6)::double as false_answer_rate,
            round(coalesce(avg(case when up then 1.0 else 0.0 end) filter (yes), 0), 6)::double as wrongly_refused_rate from e group by floor""",
        "extract_files": rf"""with f as (
            select doc_id * 4 as id, 'f' || doc_id || {ext} as filename, {ext} as ext, text from documents union all select doc_id * 4 + 1, 'g' || doc_id || '.csv', '.csv', text from documents where doc_id % 7 = 0
            union all select doc_id * 4 + 2, 'h' || doc_id, '', text from documents where doc_id % 7 = 1 union all select doc_id * 4 + 3, 'e' || doc_id || '.txt', '.txt', '' from documents where doc_id % 11 = 0),
          s as (select *, case when ext in ('.csv', '') then 415 when strlen(text) > {Settings().max_upload_mb << 20} then 413 when text = '' then 400 else 201 end as status from f),
          {text_sections_sql('select id, text from s where status = 201')},
          d as (select id, count(*) as n, string_agg(label || chr(30) || text, chr(31) order by section) as told from section group by id)
          select left(sha256(filename || ' ' || text), 32) as doc_id, filename, case when status = 201 and n is not null then 'text' end as source_type, case when status = 201 and n is null then 422 else status end as status, cast(coalesce(n, 0) as integer) as n_sections, md5(coalesce(told, '')) as sections_md5
          from s left join d using (id)""",
        "sheet_lines": """with l as (select c_nationkey, c_custkey, 'name: ' || c_name || case when c_custkey % 3 = 0 then '' else ' | col2: ' || c_mktsegment end || ' | key: ' || c_custkey as line from customer)
          select c_nationkey, md5(string_agg(line, chr(10) order by c_custkey)) as text_md5, cast(length(string_agg(line, chr(10) order by c_custkey)) as bigint) as n_chars from l group by c_nationkey""",
        "sheet_rows": """select c_nationkey, c_custkey, concat_ws(' | ', 'name: ' || nullif(c_name, ''), 'col2: ' || nullif(case when c_custkey % 3 = 0 then '' else c_mktsegment end, ''), 'key: ' || c_custkey) as line from customer""",
        "vector_store": """with v as (select *, cast(embedding as double[]) as e from embeddings), k as (select * from v where label <> 1),
          o as (select 'c' || q.vec_id as query_id, 'c' || k.vec_id as id, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.e, k.e), 9) desc, case when k.vec_id % 10 = 5 then 'again' else '' end || chr(31) || k.label || chr(31) || case when k.vec_id % 10 = 5 then '000000003' else '000000000' end, k.vec_id) as rank
            from v q join k on ('c' || q.vec_id) like 'c%00'),
          near as (select query_id, string_agg(id, ',' order by rank) as near from o where rank <= 3 group by query_id),
          p as (select *, sha1(unhex('6f1a9d1e6d5e4f4a9a9a2f0b8c7d4e11') || encode('c' || vec_id)) as h from k)
          select left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', cast(('0x' || substr(h, 17, 1))::bigint % 4 + 1 as bigint), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id,
            'c' || vec_id as chunk_id, cast(label as varchar) as doc_id, case when vec_id % 10 = 5 then 'again' else '' end as filename, '' as section_label, case when vec_id % 10 = 5 then 3 else 0 end as ordinal, 't' || vec_id as text, near,
            (select count(*) from v where label = 1) as gone, (select count(*) from k) as n from p left join near on query_id = 'c' || vec_id""",
        "text_file_sections": f"with {text_sections_sql('select doc_id as id, text from documents')} select id as doc_id, cast(row_number() over (partition by id order by section) - 1 as integer) as ordinal, label, text from section",
        "html_page_sections": f"with {PAGES} select page_id, cast(row_number() over (partition by page_id order by n) - 1 as integer) as ordinal, coalesce(name, 'body') as label, text from told where text <> ''",
        "chunks": f"with {chunk_sql('select cast(doc_id as varchar) as doc_id, source as filename, ' + chr(39) + 'body' + chr(39) + ' as label, text from documents')} select {CHUNK_ID} as chunk_id, doc_id, ordinal, length(body) as n_chars from chunk0",
    }
