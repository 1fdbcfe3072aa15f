"""Batch-at-a-time columns, for what Spark's own functions can't express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows handled at once; bounds the scratch memory of a task.
ROWS = 256
#: The same in bytes of the inputs, or one row's: rows differ in length by orders of magnitude.
BYTES = 1 << 19
#: A batch of rows on its way to a Python worker; the worker holds one, and what is made of it.
BATCH_BYTES = "8388608b"
#: Rows that a task of spread() has by default.
ROWS_IN_TASK = 2048


def spread(df: DataFrame, *keys: str, rows: int = ROWS_IN_TASK) -> DataFrame:
    """df dealt anew (by keys, if there are any) to tasks of about so many rows, counted: for work that is long for its bytes, by which scans and AQE deal."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def small_batches(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches have at most BATCH_BYTES from now on."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name) != BATCH_BYTES:
        conf.set(name, BATCH_BYTES)
    return df


def slices(batch: pa.RecordBatch, inputs: list[int], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of at most `rows` rows and about `size` bytes of the inputs; nested ones count by their batch's mean."""
    each = np.zeros(batch.num_rows, np.int64)
    for col in (batch.column(i) for i in inputs):
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type):
            each += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        else:
            each += col.nbytes // max(1, batch.num_rows)
    ends, low = np.cumsum(each), 0
    while low < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, side="right"))
        high = min(low + rows, max(fit, low + 1), batch.num_rows)
        yield batch.slice(low, high - low)
        low = high


def attach(df: DataFrame, inputs: list[str], fields: list[tuple[str, str, pa.DataType]], compute: Callable[..., list], rows: int = ROWS) -> DataFrame:
    """df with more columns: compute(*lists of the inputs' values) gives a list or an Arrow array for each of fields (name, SQL type, Arrow type)."""
    base = df.drop(*(n for n, _, _ in fields))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), *(f"`{n}` {t}" for n, t, _ in fields)])
    at = [base.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at, rows):
                new = compute(*(b.column(i).to_pylist() for i in at))
                yield pa.RecordBatch.from_arrays([*b.columns, *(x if isinstance(x, pa.Array) else pa.array(x, t) for x, (_, _, t) in zip(new, fields, strict=True))], names=[*b.schema.names, *(n for n, _, _ in fields)])

        pa.default_memory_pool().release_unused()  # the worker process lives on

    return small_batches(base).mapInArrow(run, schema)
