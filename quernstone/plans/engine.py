"""The engine: ingest, search, ask, list, delete, evaluate.

State is two append-only Parquet tables under one root: `chunks` (text, forward index and vector) and `documents` (metadata).  Every row has the
version of the commit that wrote it.  A document's newest row holds, unless it marks a deletion; chunks of other versions are left out by an
anti-join with the few superseded versions.  So ingesting and deleting cost what they add; compact() drops what is superseded.
What BM25 needs besides is aggregated from the forward index when a batch of questions comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.config import ChunkConfig, RetrievalConfig, Settings
from quernstone.functions import text as T
from quernstone.operators import answer as A
from quernstone.operators import evaluate as E
from quernstone.operators import search as S
from quernstone.operators.chunk import chunk
from quernstone.operators.embed import build_embedder, client_with
from quernstone.operators.metadata import JdbcMetadata
from quernstone.operators.rerank import build_reranker
from quernstone.operators.store import Log, latest, listing, statistics, without
from quernstone.operators.vectors import VectorStore, build_vector_store
from quernstone.sources.extract import extract, file_id, read_files, supported_extensions
from quernstone.staging import Stage, near

CHUNKS = "chunk_id string, doc_id string, filename string, section_label string, ordinal int, text string, vector array<double>, terms array<string>, tfs array<int>, len bigint"
DOCUMENTS = "doc_id string, filename string, source_type string, section_count int, chunk_count int, ingested_at timestamp"
CHUNK_LOG, DOCUMENT_LOG = f"{CHUNKS}, version bigint", f"{DOCUMENTS}, version bigint, deleted boolean"
FILES = "folder string, path string, modified timestamp, length bigint, doc_id string, version bigint"
VARIANTS = ("dense", "lexical", "hybrid", "hybrid + rerank")
RERANK_DEPTH, DEPTH = 20, 10


RESULTS = "doc_id string, filename string, source_type string, sections int, chunks int, replaced_chunks bigint, status int, error string"


class OwnChunks:
    """The engine's own chunk table as a vector store: its commits bring and take chunks, so there is nothing to put in or to delete besides."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def upsert(self, chunks: DataFrame) -> int:
        return 0

    def search(self, questions: DataFrame, limit: int = 8) -> DataFrame:
        return S.dense(self.engine.index(), questions, limit).drop("tie")

    def delete_document(self, doc_id: str) -> int:
        return 0

    def delete_documents(self, ids: DataFrame) -> int:
        return 0

    def count(self) -> int:
        return self.all_chunks().count()

    def all_chunks(self) -> DataFrame:
        return self.engine.chunks()


class Engine:
    """store: where dense searches and chunk counts go and what follows every ingest and delete; by default what the settings' vector_backend names.

    A store of its own commits by itself: after a stop between the two commits, ingesting the same again makes it good.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, settings: Settings | None = None, embedder=None, reranker=None, llm=None, store: VectorStore | None = None):
        self.spark, self.settings = spark, settings or Settings()
        s = self.settings
        self.log, self.table = Log(spark, root or s.qdrant_url or s.root), s.qdrant_collection
        self.embedder = embedder or build_embedder(s.embedder, s.embedding_dimensions, client_with(s.openai_api_key))
        self.store = store or build_vector_store(s.vector_backend, Log(spark, f"{self.log.root}/vectors"), self.embedder.dimensions, OwnChunks(self))
        self.reranker = reranker or build_reranker(s.reranker)
        self.llm = llm or A.build_llm(s.llm, client_with(s.openai_api_key))
        self.chunk_config = ChunkConfig(s.chunk_max_chars, s.chunk_overlap_chars)
        self.retrieval = RetrievalConfig(final_k=s.candidate_k)
        self._old: tuple[int, DataFrame | None] = (-1, None)

    # -- state ---------------------------------------------------------------------------------------------------------

    def _history(self) -> DataFrame:
        return self.log.read("documents", DOCUMENT_LOG)

    def _live(self) -> DataFrame:
        return latest(self._history(), ["doc_id"], "version").where("not deleted")

    def chunks(self) -> DataFrame:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        rows, old = self.log.read(self.table, CHUNK_LOG), self._superseded()
        return (rows if old is None else rows.join(old, ["doc_id", "version"], "left_anti")).select(*names)

    def _superseded(self) -> DataFrame | None:
        """(doc_id, version) of the versions whose chunks no longer hold, found once a commit; None without any.  Few are sent along, so the chunks aren't shuffled."""
        now = self.log.manifest()
        if self._old[0] != now["version"]:
            newest = self._history().groupBy("doc_id").agg(F.max(F.struct("version", "deleted")).alias("m"), F.collect_set(F.when(~F.col("deleted"), F.col("version"))).alias("had"))
            old = newest.select("doc_id", F.explode("had").alias("version"), "m").where((F.col("version") < F.col("m.version")) | F.col("m.deleted")).select("doc_id", "version")
            # one segment has each document once and no deletion
            old = Stage(self.spark).keep(old, "old") if len(now["tables"].get("documents", [])) > 1 else None
            self._old = now["version"], None if old is None or old.isEmpty() else near(old)
        return self._old[1]

    def documents(self) -> DataFrame:
        return listing(self._live().select(*(c.split()[0] for c in DOCUMENTS.split(", "))))

    def get(self, doc_id: str) -> DataFrame:
        return latest(self._history().where(F.col("doc_id") == doc_id), ["doc_id"], "version").where("not deleted")

    def index(self) -> DataFrame:
        """The chunks as the searches want them; ties go by file name, document and place."""
        tie = F.concat_ws("\x1f", "filename", "doc_id", F.lpad(F.col("ordinal").cast("string"), 9, "0"))
        return self.chunks().withColumn("id", F.col("chunk_id")).withColumn("tie", tie)

    def stats(self) -> dict:
        row = statistics(self._live()).first()
        return {"documents": row["documents"], "chunks": row["chunks"], "indexed_chunks": self.store.count()}

    def health(self) -> dict:
        s, n = self.settings, self.stats()
        return {"status": "ok", "vector_backend": s.vector_backend, "embedder": self.embedder.name, "reranker": self.reranker.name, "llm": self.llm.name, "documents": n["documents"], "chunks": n["indexed_chunks"]}

    def metrics(self) -> dict:
        """Counts and kinds; nothing where the settings turn metrics off."""
        if not self.settings.enable_metrics:
            return {}
        n = self.stats()
        return {"documents": n["documents"], "indexed_chunks": n["indexed_chunks"], "vector_backend": self.settings.vector_backend, "embedding_dimensions": self.embedder.dimensions, "supported_extensions": supported_extensions()}

    # -- mutation -------------------------------------------------------------------------------------------------------

    def ingest(self, paths: list[str] | str) -> DataFrame:
        """Reads files and puts them in place of documents with their ids; a row a file, with its status and error."""
        return self.ingest_documents(self.extracted(read_files(self.spark, paths)))

    def extracted(self, files: DataFrame) -> DataFrame:
        """Rows of binaryFile as DOCUMENT rows, within the settings' limits."""
        return extract(files, self.settings.max_upload_mb << 20, self.settings.sheet_max_rows or None)

    def ingest_documents(self, documents: DataFrame) -> DataFrame:
        """The same for DOCUMENT rows: one commit of new segments, in which a document's chunks and its metadata come together."""
        number = self.log.manifest()["version"] + 1
        version = F.lit(number).cast("long").alias("version")
        read, stage = documents.persist(), Stage(self.spark)
        try:
            # of rows with one id that with the greatest hash of its content holds, whichever task finds it; only such rows are shuffled with their texts
            valid = read.where("error is null")
            twice = stage.keep(valid.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").select("__id"), "twice")
            good = valid
            if not twice.isEmpty():
                few, same = near(twice), valid["doc_id"].eqNullSafe(twice["__id"])
                again = valid.join(few, same, "left_semi").withColumn("__h", F.xxhash64("filename", "source_type", "sections"))
                good = valid.join(few, same, "left_anti").unionByName(latest(again, ["doc_id"], "__h").drop("__h").select(*valid.columns))
            made = S.with_terms(self.embedder.embed(chunk(good, self.chunk_config))).select(*(c.split()[0] for c in CHUNKS.split(", ")))
            segment = self.log.write(self.table, made.select("*", version), number)
            made = self.log.segment(segment, CHUNK_LOG).drop("version")
            counts = made.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
            before = self._live().select("doc_id", F.col("chunk_count").cast("long").alias("replaced_chunks"))
            # the texts stay behind: a join would shuffle them
            size = F.size("sections")
            told = read.select("doc_id", "filename", "source_type", size.alias("sections"), "status", "error")
            rows = told.join(counts, "doc_id", "left").join(before, "doc_id", "left").select(
                "doc_id", "filename", "source_type", "sections", F.coalesce("chunk_count", F.lit(0)).alias("chunks"), F.coalesce("replaced_chunks", F.lit(0)).cast("long").alias("replaced_chunks"), "status", "error", version
            )
            known = good.select("doc_id", "filename", "source_type", size.alias("section_count"))
            meta = known.join(counts, "doc_id", "left").select(*known.columns, F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.current_timestamp().alias("ingested_at"), version, F.lit(False).alias("deleted"))
            self.log.commit({"results": rows, self.table: segment, "documents": meta}, version=number)
            self.store.delete_documents(good.select("doc_id"))
            self.store.upsert(made)
            stage.drop(twice)
        finally:
            read.unpersist()
        return self.log.read("results", f"{RESULTS}, version bigint").where(F.col("version") == number).drop("version")

    def mirror_documents(self, table: str = "documents") -> int:
        """Brings a table of the database that the settings name up to date with the metadata of all documents; how many rows it put there."""
        if not self.settings.database_url:
            raise ValueError("the settings name no database_url")
        there, now = JdbcMetadata(self.spark, self.settings.database_url, table), self.documents()
        for r in without(there.documents(), now, ["doc_id"]).select("doc_id").toLocalIterator():
            there.delete(r["doc_id"])
        return there.upsert(now)

    def delete(self, doc_id: str) -> int | None:
        """Chunks removed; None where there is no such document."""
        row = self.get(doc_id).first()
        if row is None:
            return None
        version = self.log.manifest()["version"] + 1
        self.log.commit({"documents": self.spark.createDataFrame([row.asDict() | {"version": version, "deleted": True}], DOCUMENT_LOG)}, version=version)
        self.store.delete_document(doc_id)
        return row["chunk_count"]

    def delete_all(self, ids: DataFrame) -> int:
        """Deletes the documents with these ids (doc_id) in one commit; how many there were."""
        number = self.log.manifest()["version"] + 1
        gone = self._live().join(ids.select("doc_id").distinct(), "doc_id", "left_semi").withColumns({"version": F.lit(number).cast("long"), "deleted": F.lit(True)})
        gone = Stage(self.spark).keep(gone.select(*(c.split()[0] for c in DOCUMENT_LOG.split(", "))), "gone")
        n = gone.count()
        if n:
            self.log.commit({"documents": gone}, version=number)
            self.store.delete_documents(gone)
        return n

    def sync(self, folder: str) -> dict[str, int]:
        """Makes the index hold what a folder holds: counts of its files that were listed, read, and gone, and of documents deleted.

        A file whose time and size are those of the last sync is not opened.  Files that are new or changed are read; what a changed or removed
        file gave before is deleted unless another file gives it too.  Files that can't be read are tried again when they change.  Running
        it again, also after it was stopped half-way, ends in the same state.
        """
        stage = Stage(self.spark)
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
        known = stage.keep(self._files(folder), "known")
        new = stage.keep(listed.join(known, ["path", "modified", "length"], "left_anti"), "new")
        lost = stage.keep(known.join(listed, "path", "left_anti"), "lost")
        n_new, n_lost, since = new.count(), lost.count(), new.agg(F.min("modified")).first()[0]
        out = {"listed": listed.count(), "read": n_new, "gone": n_lost, "deleted": 0}
        if not n_new and not n_lost:
            return out
        rows = lost.select("path", "modified", "length", F.lit(None).cast("string").alias("doc_id"))
        if n_new:
            # the time is a filter that keeps older files from being opened; the join leaves exactly the new ones
            files = read_files(self.spark, folder).where(F.col("modificationTime") >= F.lit(since)).join(new.select("path"), "path", "left_semi")
            self.ingest_documents(self.extracted(files)).count()
            rows = rows.unionByName(new.join(files.select("path", file_id(F.col("path"), F.col("content")).alias("doc_id")), "path").select("path", "modified", "length", "doc_id"))
        number = self.log.manifest()["version"] + 1
        said = rows.select(F.lit(folder).alias("folder"), "path", "modified", "length", "doc_id", F.lit(number).cast("long").alias("version"))
        self.log.commit({"files": said}, version=number)
        held = self._files(folder)
        before = known.join(rows.select("path"), "path", "left_semi").select("doc_id").distinct()
        out["deleted"] = self.delete_all(before.join(held.select("doc_id"), "doc_id", "left_anti"))
        stage.drop(known, new, lost)
        return out

    def _files(self, folder: str) -> DataFrame:
        """(path, modified, length, doc_id) of a folder's files at the last sync."""
        rows = self.log.read("files", FILES).where(F.col("folder") == folder).drop("folder")
        return latest(rows, ["path"], "version").where("doc_id is not null").select("path", "modified", "length", "doc_id")

    def compact(self) -> None:
        """Both tables anew without what is superseded or deleted; the old segments go."""
        number = self.log.manifest()["version"] + 1
        version = F.lit(number).cast("long").alias("version")
        live = self.documents().select("*", version, F.lit(False).alias("deleted"))
        self.log.commit({self.table: self.chunks().select("*", version), "documents": live}, replace=True, version=number)

    # -- questions -----------------------------------------------------------------------------------------------------

    def _with_vectors(self, questions: DataFrame) -> DataFrame:
        return self.embedder.embed(questions, "question", "vector")

    def hits(self, questions: DataFrame, mode: str, limit: int) -> DataFrame:
        index = self.index()
        if mode == "lexical":
            return S.lexical(index, questions, limit).drop("tie")
        questions = self._with_vectors(questions)
        if mode == "dense":
            return self.store.search(questions, limit)
        c = self.retrieval
        return S.fuse([self.store.search(questions, c.dense_k), S.lexical(index, questions, c.lexical_k)], [c.dense_weight, c.lexical_weight], c.rrf_k, limit or c.final_k)

    def _passages(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        text = self.chunks().select(F.col("chunk_id").alias("id"), "doc_id", "filename", "section_label", "text", T.citation(F.col("filename"), F.col("section_label")).alias("citation"))
        found = Stage(self.spark).keep(hits.join(questions, "query_id"), "hits")  # k rows a question
        return near(found).join(text, "id")

    def search(self, questions: DataFrame, mode: str = "hybrid", limit: int = 6) -> DataFrame:
        """Passages of each question (query_id, question): id, text, citation, section_label, filename, score, method, rank."""
        if mode not in ("hybrid", "dense", "lexical"):
            raise ValueError(f"no mode named {mode!r}")
        if not 1 <= limit <= 50:
            raise ValueError("limit must be from 1 to 50")
        if not questions.where((F.length("question") < 1) | (F.length("question") > 2000) | F.col("question").isNull()).isEmpty():
            raise ValueError("a question has from 1 to 2000 characters")
        found = self._passages(questions, self.hits(questions, mode, limit))
        return found.select("query_id", "question", "id", "text", "citation", "section_label", "filename", F.round("score", 4).alias("score"), "method", "rank")

    def ask(self, questions: DataFrame, floor: float | None = None) -> DataFrame:
        """An answer a question: text, grounded, escalated, confidence, citations, passages, intent, handler.

        The intent says how many passages are read; an inventory question is answered from the list of documents.
        """
        out = self._answered(questions, self.settings.min_relevance if floor is None else floor)
        return out.select("query_id", "question", "text", "grounded", "escalated", "confidence", "citations", "passages", "intent", "handler")

    def _answered(self, questions: DataFrame, floor: float) -> DataFrame:
        """The same with `top`, the best passage's score as it is compared with the floor; null where no passage counts."""
        q = questions.select("query_id", T.strip(F.coalesce("question", F.lit(""))).alias("question")).withColumn("intent", T.intent(F.col("question")))
        depth, handler = F.lit(None).cast("int"), F.lit(None).cast("string")
        for name, (k, said) in A.HANDLERS.items():
            depth = F.when(F.col("intent") == name, self.settings.context_k if k is None else k).otherwise(depth)
            handler = F.when(F.col("intent") == name, F.lit(said)).otherwise(handler)
        q = q.withColumn("context_k", depth).withColumn("handler", handler)
        searched = q.where("intent <> 'inventory' and question <> ''")
        candidates = self._passages(searched, self.hits(searched.select("query_id", "question"), "hybrid", self.settings.candidate_k))
        passages = Stage(self.spark).keep(self.reranker.rerank(candidates, F.col("context_k")), "passages")  # a few rows a question, read three times
        out = A.answer(q, passages, self.llm, floor)
        if q.where("intent = 'inventory'").isEmpty():  # the list of all names is made only where it is asked for
            listed = self.spark.createDataFrame([(None, None)], "stock string, no_stock boolean")
        else:
            listed = A.inventory(self._live()).select(F.col("text").alias("stock"), F.col("escalated").alias("no_stock"))
        out = out.crossJoin(F.broadcast(listed))  # one row on the right
        stock = F.col("intent") == "inventory"
        out = out.withColumns({"text": F.when(stock, F.col("stock")).otherwise(F.col("text")), "escalated": F.when(stock, F.col("no_stock")).otherwise(F.col("escalated"))})
        return out.withColumn("grounded", ~F.col("escalated")).withColumn("top", F.when(stock, F.when(~F.col("escalated"), F.lit(float("inf")))).otherwise(F.col("top")))

    # -- evaluation ------------------------------------------------------------------------------------------------------

    def rankings(self, questions: DataFrame) -> DataFrame:
        """(variant, query_id, id, rank) of the four variants to DEPTH."""
        index, q = self.index(), self._with_vectors(questions.select("query_id", "question"))
        c, stage = self.retrieval, Stage(self.spark)  # k rows a question each, read several times
        d, x = stage.keep(self.store.search(q, c.dense_k), "dense"), stage.keep(S.lexical(index, q, c.lexical_k).drop("tie"), "lexical")
        fused = stage.keep(S.fuse([d, x], [c.dense_weight, c.lexical_weight], c.rrf_k, RERANK_DEPTH), "fused")
        again = self.reranker.rerank(self._passages(questions.select("query_id", "question"), fused), DEPTH)
        frames = [f.where(F.col("rank") <= DEPTH).select(F.lit(v).alias("variant"), "query_id", "id", "rank") for v, f in zip(VARIANTS, (d, x, fused, again), strict=True)]
        return stage.keep(frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3]), "ranks")

    def evaluate(self, questions: DataFrame) -> dict[str, dict]:
        """Metrics of each variant over the answerable questions (query_id, question, relevant)."""
        E.guard_index_size(self.chunks().count(), DEPTH)
        keys = self.chunks().select("chunk_id", T.section_key(F.col("filename"), F.col("section_label")).alias("key"))
        E.validate(questions, keys)
        some = questions.where(F.size("relevant") > 0)
        ranks = near(self.rankings(some)).join(keys, F.col("id") == F.col("chunk_id")).join(some.select("query_id", "relevant"), "query_id")
        ranks = ranks.select("variant", "query_id", "rank", F.array_contains("relevant", F.col("key")).cast("int").alias("hit"))
        ranks = Stage(self.spark).keep(ranks, "ranks")
        n = some.select("query_id", F.size("relevant").alias("n_relevant"))
        out = {v: E.retrieval_scores(n, ranks.where(F.col("variant") == v)).first().asDict() for v in VARIANTS}
        return out

    def evaluate_refusal(self, questions: DataFrame, floor: float | None = None) -> dict:
        answers = self.ask(questions.select("query_id", "question"), floor).join(questions.select("query_id", (F.size("relevant") > 0).alias("answerable")), "query_id")
        return E.refusal_scores(answers).first().asDict()

    def refusal_sweep(self, questions: DataFrame, floors: list[float]) -> DataFrame:
        """Both refusal rates at each floor; the questions (query_id, question, relevant) are answered once."""
        return E.refusal_sweep(self._scores(questions), floors)

    def refusal_curve(self, questions: DataFrame, places: int = 4) -> DataFrame:
        """The same at every score that occurs; E.best_floor picks one by its cost."""
        return E.refusal_curve(self._scores(questions), places)

    def _scores(self, questions: DataFrame) -> DataFrame:
        answerable = questions.select("query_id", (F.size("relevant") > 0).alias("answerable"))
        told = self._answered(questions.select("query_id", "question"), float("-inf")).join(answerable, "query_id")
        return told.select("answerable", F.col("top").alias("score"), F.col("escalated").alias("refused"))
