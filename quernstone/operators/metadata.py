"""Document metadata in a relational database, behind the functions that the engine's own table has.

Rows are written in parallel by Spark's JDBC writer into a staging table of their own, and one MERGE statement puts them in the place of the rows with
their ids, so readers see all of an upsert or nothing of it.  Reads are split by ranges of ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import listing, statistics

COLUMNS = ("doc_id", "filename", "source_type", "section_count", "chunk_count", "ingested_at")
TABLE = "doc_id VARCHAR(64) NOT NULL PRIMARY KEY, filename VARCHAR(512) NOT NULL, source_type VARCHAR(16) NOT NULL, section_count INTEGER NOT NULL, chunk_count INTEGER NOT NULL, ingested_at TIMESTAMP NOT NULL"
TYPES = "doc_id VARCHAR(64), filename VARCHAR(512), source_type VARCHAR(16)"
#: Ids are hex digests; these are the first characters at which reads are split.
SPLITS = "048c"


class JdbcMetadata:
    """The table is made where it isn't there.  Only standard statements are used, MERGE among them; names are not quoted."""

    def __init__(self, spark: SparkSession, url: str, table: str = "documents", properties: dict[str, str] | None = None):
        if not url.startswith("jdbc:"):
            raise ValueError(f"no JDBC address: {url!r}")
        if not table.isidentifier():
            raise ValueError(f"no table name: {table!r}")
        self.spark, self.url, self.table, self.properties = spark, url, table, properties or {}
        if not self._exists():
            self._run(f"CREATE TABLE {table} ({TABLE})")

    @contextmanager
    def _connection(self) -> Iterator:
        jvm = self.spark.sparkContext._jvm
        given = jvm.java.util.Properties()
        for k, v in self.properties.items():
            given.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, given)
        try:
            yield connection
        finally:
            connection.close()

    def _exists(self) -> bool:
        with self._connection() as c:
            found = c.getMetaData().getTables(None, None, "%", None)
            while found.next():
                if found.getString("TABLE_NAME").lower() == self.table.lower():
                    return True
        return False

    def _run(self, statement: str, *values: str) -> int:
        with self._connection() as c:
            prepared = c.prepareStatement(statement)
            for i, v in enumerate(values, 1):
                prepared.setString(i, v)
            return prepared.executeUpdate()

    def upsert(self, documents: DataFrame) -> int:
        """Rows with COLUMNS (ingested_at: now where it isn't given) in place of those with their ids; how many.  Of equal ids that with the greatest (filename, ...) holds."""
        at = F.coalesce("ingested_at", F.current_timestamp()) if "ingested_at" in documents.columns else F.current_timestamp()
        rows = documents.withColumn("ingested_at", at).select(*COLUMNS)
        rows = rows.groupBy("doc_id").agg(F.max(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
        staging = f"staged_{uuid.uuid4().hex}"
        try:
            rows.write.option("createTableColumnTypes", TYPES).jdbc(self.url, staging, mode="errorifexists", properties=self.properties)
            # Spark quotes the names of the table that it makes
            new = {c: f's."{c}"' for c in COLUMNS}
            sets = ", ".join(f"{c} = {new[c]}" for c in COLUMNS[1:])
            merged = f"MERGE INTO {self.table} t USING {staging} s ON t.doc_id = {new['doc_id']} WHEN MATCHED THEN UPDATE SET {sets} WHEN NOT MATCHED THEN INSERT ({', '.join(COLUMNS)}) VALUES ({', '.join(new.values())})"
            return self._run(merged)
        finally:
            try:
                self._run(f"DROP TABLE {staging}")
            except Exception:  # noqa: BLE001  it was never made
                pass

    def _read(self, predicates: list[str] | None = None) -> DataFrame:
        if predicates is None:
            edges = [f"'{c}'" for c in SPLITS]
            low = [f"doc_id < {edges[1]}", *(f"doc_id >= {a} AND doc_id < {b}" for a, b in zip(edges[1:], edges[2:], strict=False)), f"doc_id >= {edges[-1]}"]
            predicates = low
        found = self.spark.read.jdbc(self.url, self.table, predicates=predicates, properties=self.properties)
        return found.toDF(*(c.lower() for c in found.columns)).select(*COLUMNS)

    def get(self, doc_id: str) -> DataFrame:
        """One row or none; the database looks it up by its key."""
        said = doc_id.replace("'", "''")
        return self._read([f"doc_id = '{said}'"])

    def documents(self) -> DataFrame:
        return listing(self._read())

    def delete(self, doc_id: str) -> bool:
        return self._run(f"DELETE FROM {self.table} WHERE doc_id = ?", doc_id) > 0

    def stats(self) -> dict:
        return statistics(self._read()).first().asDict()
