"""Mutations as DataFrame operations, and their Parquet tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of each key with the largest version; the aggregate combines before its shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("__r")).select(*key, "__r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def without(old: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return old.join(gone.select(*key).distinct(), key, "left_anti")


def statistics(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("doc_id").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunks"))


def listing(documents: DataFrame) -> DataFrame:
    return documents.orderBy("filename", "doc_id")


class CommitConflict(RuntimeError):
    """Another commit came between; read again and repeat."""


class Log:
    """Append-only Parquet segments of some tables under one root.

    A commit writes new segments, then one manifest that lists all segments of all tables; the newest manifest is what holds.  So a commit
    costs what it adds, however large the tables are, a failed one leaves no trace in any table, and of two commits at once the
    second fails because its manifest exists.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """{"version": n, "tables": {name: [segment, ...]}} of the newest commit."""
        there = self.path(f"{self.root}/manifests")
        names = [f.getPath().getName() for f in self.fs.listStatus(there)] if self.fs.exists(there) else []
        newest = max((n for n in names if n.endswith(".json")), default=None)
        if newest is None:
            return {"version": 0, "tables": {}}
        stream = self.fs.open(self.path(f"{self.root}/manifests/{newest}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, schema: str) -> DataFrame:
        segments = self.manifest()["tables"].get(name)
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s}" for s in segments))

    def write(self, name: str, df: DataFrame, version: int) -> str:
        """A new segment of a table, which is none of its segments until a commit takes it."""
        segment = f"{name}/{version:012d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{segment}")
        return segment

    def segment(self, segment: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{segment}")

    def commit(self, added: dict[str, DataFrame | str], replace: bool = False, version: int | None = None) -> int:
        """Adds rows to tables (replace: puts them in the place of all their rows), or segments written before; the new version.

        version: the one that the rows carry.  If another commit has taken it since, nothing changes and CommitConflict is raised.
        """
        now = self.manifest()
        if version is not None and version != now["version"] + 1:
            raise CommitConflict(f"version {version} is no longer the next one; the newest is {now['version']}")
        version, tables, gone = now["version"] + 1, dict(now["tables"]), []
        for name, df in added.items():
            segment = df if isinstance(df, str) else self.write(name, df, version)
            gone += tables.get(name, []) if replace else []
            tables[name] = [segment] if replace else [*tables.get(name, []), segment]
        at = self.path(f"{self.root}/manifests/{version:012d}.json")
        try:
            out = self.fs.create(at, False)
        except Exception as e:
            if self.fs.exists(at):
                raise CommitConflict(f"another commit has become version {version}") from e
            raise
        out.write(bytearray(json.dumps({"version": version, "tables": tables}).encode()))
        out.close()
        for segment in gone:
            self.fs.delete(self.path(f"{self.root}/{segment}"), True)
        return version
