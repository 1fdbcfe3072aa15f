"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that stand on disk go to all executors up to so many rows, counted; Spark can't tell how small they are.
BROADCAST_ROWS = 200_000


class NoSharedFolder(RuntimeError):
    """The session runs on a cluster and names no folder that its machines share."""


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a session whose driver and executors are one local process (tests) gets a temporary folder, removed at exit; any
    other one is refused, as its executors could not see a folder of the driver's machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quern_shared", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark._quern_shared = found
    return found


def near(df: DataFrame) -> DataFrame:
    """A table that was written as one that a join sends along, if it has few rows: the other side isn't shuffled then."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Stage:
    """Writes intermediate tables into the shared folder, so that a lost executor costs a reread, not a recomputation.

    ``keep`` writes and rereads a frame; ``drop`` removes tables that nothing reads any more.  What a returned plan still reads is removed
    when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}", {}

    def _files(self, path: str):
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(sc._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.parquet(path)
        if not self.paths:
            at, fs = self._files(self.root)
            fs.deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._quern_path = path
        return out

    def append(self, df: DataFrame, name: str) -> str:
        """Adds rows to a table; what read() takes."""
        path = f"{self.root}/{name}"
        df.write.mode("append").parquet(path)
        if not self.paths:
            at, fs = self._files(self.root)
            fs.deleteOnExit(at)
        self.paths[name] = path
        return path

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.paths[name])

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, fs = self._files(df._quern_path)
            fs.delete(path, True)
