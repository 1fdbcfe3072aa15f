"""What the operators of this folder share: staging, bounded samples and batches of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.staging import Stage, shared_dir

__all__ = ["Stage", "attach", "bounded_sample", "codes", "crc_mod", "fresh", "shared_dir", "slices", "small_batches", "table"]

#: Texts are handled in slices of about so many characters, so that scratch memory is bounded by a slice or by the longest text.
SLICE_CHARS = 1 << 19
BATCH_BYTES = "8388608b"
#: Counted labels go to all executors up to so many.
BROADCAST_LABELS = 100_000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, m: int) -> Column:
    """crc32 of an id's decimal text, mod m; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def bounded_sample(df: DataFrame, label: str, keys: str | list[str], per_class: int) -> DataFrame:
    """About per_class rows of each label at most, the same ones whatever the partitioning; equal (label, keys) give one row.

    A row stays where the hash of its keys lies under per_class / (rows of its label).  As rows with equal keys share their hash and only one of them
    stays, the expected number is at most per_class a label also where one key is repeated any number of times.  Counting takes a pass over
    the labels; the aggregates combine before their shuffles.  All keys of a label with at most per_class rows stay, so only the labels with
    more, a per_class-th of the rows at most, meet the rows: by a broadcast up to BROADCAST_LABELS of them, counted, beyond that by a join on label and
    salt, so that no label's rows need meet in one task.  Both ways give the same rows.  Rows without a label are left out.
    """
    keys = [keys] if isinstance(keys, str) else keys
    stage = Stage(df.sparkSession)
    share = stage.keep(df.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n")).where(F.col("__n") > per_class), "share")
    h = F.xxhash64(F.lit(77), *keys)
    u = h.bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    kept, same = df.where(F.col(label).isNotNull()), F.col(label) == F.col("__label")
    if share.count() <= BROADCAST_LABELS:
        kept = kept.join(F.broadcast(share), same, "left")
    else:
        share = share.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        kept = kept.join(share, same & (F.pmod(h, F.lit(SALTS)) == F.col("__salt")), "left").drop("__salt")
    kept = kept.where(F.col("__n").isNull() | (u * F.col("__n") < per_class)).drop("__label", "__n")
    return kept.dropDuplicates([label, *keys])


def one_text(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each (key, other columns but the text): that with the smallest hash of its text.  It combines before its shuffle."""
    rest = [c for c in rows.columns if c != text]
    first = F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t"))).alias("__t")
    return rows.groupBy(*rest).agg(first).select(*rest, F.col("__t.t").alias(text))


def slices(batches: Iterator[pa.RecordBatch], text: int, chars: int = SLICE_CHARS, each: int = 16) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Record batches cut so that each has about `chars` characters, where each text adds `each`; with the texts, '' for null."""
    for batch in batches:
        col = batch.column(text)
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cut = np.cumsum(sizes + each) // chars
        starts = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), n]
        for a, b in zip(starts, starts[1:], strict=False):
            if b > a:
                part = batch.slice(a, b - a)
                yield part, [x if x is not None else "" for x in part.column(text).to_pylist()]
    pa.default_memory_pool().release_unused()  # the worker process lives on


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a newline; and where each text starts (one more entry ends the last)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum(sizes)))


def small_batches(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches have at most BATCH_BYTES from now on: the JVM holds one outside its heap for each task, the worker another."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name) != BATCH_BYTES:
        conf.set(name, BATCH_BYTES)
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def attach(docs: DataFrame, fields: list[tuple[str, str, pa.DataType]], compute, text_col: str = "text", each: int = 16) -> DataFrame:
    """The rows of docs with more columns: compute(texts) gives an array for each of fields (name, SQL type, Arrow type).

    One pass without a shuffle.  The new names must not be among the columns of docs (see fresh()).
    """
    at = docs.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"`{n}` {t}" for n, t, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, at, each=each):
            new = [pa.array(x, kind) for x, (_, _, kind) in zip(compute(texts), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(n for n, _, _ in fields)])

    return small_batches(docs).mapInArrow(run, schema)
