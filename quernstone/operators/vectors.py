"""A store of chunks with vectors of one width, behind one seam for every backend."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.staging import Stage

from . import search as S
from .store import Log, latest, without

POINT = "point_id string, chunk_id string, doc_id string, filename string, section_label string, ordinal int, text string, vector array<double>, version bigint"
#: Fixed value: the name space of point ids.
NAMESPACE = "6f1a9d1e6d5e4f4a9a9a2f0b8c7d4e11"


class VectorStore(Protocol):
    def upsert(self, chunks: DataFrame) -> int: ...

    def search(self, questions: DataFrame, limit: int = 8) -> DataFrame: ...

    def delete_document(self, doc_id: str) -> int: ...

    def delete_documents(self, ids: DataFrame) -> int: ...

    def count(self) -> int: ...

    def all_chunks(self) -> DataFrame: ...


def point_id(chunk_id: Column) -> Column:
    """The version-5 UUID of a chunk id in NAMESPACE, as an expression."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), chunk_id.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


class TableStore:
    """Append-only: the newest write of a chunk holds, unless its document was deleted later.  Nothing caps a scan."""

    def __init__(self, log: Log, dimensions: int, name: str = "points"):
        if dimensions <= 0:
            raise ValueError("dimensions must be positive")
        self.log, self.dimensions, self.name = log, dimensions, name

    def upsert(self, chunks: DataFrame) -> int:
        """Rows (chunk_id, doc_id, text, vector and, if they are there, filename, section_label, ordinal); how many.  No rows: no commit.

        Of rows with one chunk_id that with the greatest ordinal, then text, then of the other columns holds.
        """
        vector = F.col("vector").cast("array<double>")
        size = chunks.agg(F.count("*").alias("n"), F.count_if(vector.isNull() | (F.size(vector) != self.dimensions)).alias("bad")).first()
        if size["bad"]:
            raise ValueError(f"{size['bad']} vectors don't have {self.dimensions} numbers")
        if not size["n"]:
            return 0
        of = lambda name, kind, none: F.coalesce(F.col(name).cast(kind) if name in chunks.columns else F.lit(None).cast(kind), F.lit(none)).alias(name)
        number = self.log.manifest()["version"] + 1
        version = F.lit(number).cast("long").alias("version")
        rows = chunks.select(point_id(F.col("chunk_id")).alias("point_id"), "chunk_id", "doc_id", of("filename", "string", ""), of("section_label", "string", ""), of("ordinal", "int", 0), "text", vector.alias("vector"), version)
        rest = [c for c in rows.columns if c != "chunk_id"]
        one = rows.groupBy("chunk_id").agg(F.max(F.struct("ordinal", "text", *(c for c in rest if c not in ("ordinal", "text")))).alias("r")).select("chunk_id", "r.*").select(*rows.columns)
        self.log.commit({self.name: one}, version=number)
        return size["n"]

    def all_chunks(self) -> DataFrame:
        newest = latest(self.log.read(self.name, POINT), ["chunk_id"], "version")
        gone = self.log.read(f"{self.name}_gone", "doc_id string, version bigint").groupBy("doc_id").agg(F.max("version").alias("gone"))
        dead = newest.join(gone, "doc_id").where("version < gone").select("chunk_id")
        return without(newest, dead, ["chunk_id"]).drop("version")

    def search(self, questions: DataFrame, limit: int = 8) -> DataFrame:
        """Exact cosine of (query_id, vector): query_id, id (the chunk's), score, method, rank; ties by file name, document and place."""
        tie = F.concat_ws("\x1f", "filename", "doc_id", F.lpad(F.col("ordinal").cast("string"), 9, "0"))
        return S.dense(self.all_chunks().withColumn("id", F.col("chunk_id")).withColumn("tie", tie), questions, limit).drop("tie")

    def delete_document(self, doc_id: str) -> int:
        n = self.all_chunks().where(F.col("doc_id") == doc_id).count()
        if n:
            version = self.log.manifest()["version"] + 1
            self.log.commit({f"{self.name}_gone": self.log.spark.createDataFrame([(doc_id, version)], "doc_id string, version bigint")}, version=version)
        return n

    def delete_documents(self, ids: DataFrame) -> int:
        """The same for all ids (doc_id) of a table, in one commit."""
        version = self.log.manifest()["version"] + 1
        held = self.all_chunks().join(ids.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))
        stage = Stage(self.log.spark)
        held = stage.keep(held, "gone")
        n = held.agg(F.sum("n")).first()[0] or 0
        if n:
            self.log.commit({f"{self.name}_gone": held.select("doc_id", F.lit(version).cast("long").alias("version"))}, version=version)
        stage.drop(held)
        return n

    def count(self) -> int:
        return self.all_chunks().count()


def build_vector_store(kind: str = "memory", log: Log | None = None, dimensions: int = 384, own: VectorStore | None = None) -> VectorStore:
    """memory: the engine's own chunk table, where it gives one; qdrant, and memory without: a table of points beside it.  Other names are refused."""
    if kind not in ("memory", "qdrant"):
        raise ValueError(f"no vector store named {kind!r}")
    return own if kind == "memory" and own is not None else TableStore(log, dimensions)
