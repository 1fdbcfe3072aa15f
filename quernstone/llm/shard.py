"""Sharding by longest processing time.

Groups that must stay together (equal texts) are the jobs, their bytes the processing time.  Sorted by size they go to the
least-loaded shard through a heap.  Groups of equal size are interchangeable, so what the heap gets is not a row a group but a row a size, with
the number of groups of that size: a run of n equal jobs goes to the shards by the n smallest of the loads at which each shard would begin its
next one, which is what n turns of the heap would do.

So the driver holds a row for each distinct size: groups of more than 1 / LARGE of all bytes or rows by themselves (there are under 2 LARGE),
sizes up to EXACT bytes as they are, and larger ones in steps of 1/512 of their size, a step's groups counted with their mean: at most
2 LARGE + EXACT + 256 for each doubling beyond EXACT, however many texts there are.

Which groups of a size go to which shard is decided by their number within the size, given in buckets with running offsets, and slots are numbered in
the same way; so neither a size that very many texts have nor a group of copies with a third of all rows meets in one task.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, fresh, table

N_SHARDS = 16
LARGE = 4096
EXACT = 65_536
STEP_BITS = 9
PART_ROWS = 50_000


def deal(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n jobs of one size each shard gets: of the values load + i * size (i = 0, 1, ...) the n smallest, ties to the smaller shard."""
    at = np.array(loads, dtype=object)
    low, high = int(min(at)), int(max(at)) + size * (n + 1)  # the largest value that is taken
    while low < high:
        mid = (low + high) // 2
        if sum(max(0, (mid - x) // size + 1) for x in at) >= n:
            high = mid
        else:
            low = mid + 1
    out = [max(0, (low - 1 - x) // size + 1) for x in at]
    left = n - sum(out)
    for s, x in enumerate(at):
        if left and x <= low and (low - x) % size == 0:
            out[s] += 1
            left -= 1
    return out


def lpt(jobs: list[tuple[str, int, int]], n_shards: int) -> dict[str, list[int]]:
    """For each job (name, size, how many) the number that each shard gets: largest size first, each to the least-loaded shard (ties: the smaller one)."""
    heap = [(0, s) for s in range(n_shards)]
    out = {}
    for name, size, n in sorted(jobs, key=lambda j: (-j[1], j[0])):
        if n <= n_shards:
            got = [0] * n_shards
            for _ in range(n):
                load, s = heap[0]
                got[s] += 1
                heapq.heapreplace(heap, (load + size, s))
        else:
            loads = [0] * n_shards
            for load, s in heap:
                loads[s] = load
            got = deal(loads, size, n)
            heap = [(x + k * size, s) for s, (x, k) in enumerate(zip(loads, got, strict=True))]
            heapq.heapify(heap)
        out[name] = got
    return out


def size_class(size: Column) -> Column:
    """The size itself up to EXACT; beyond, the size without all but its STEP_BITS leading bits."""
    drop = F.greatest(F.floor(F.log2(size.cast("double"))).cast("int") - (STEP_BITS - 1), F.lit(0))
    return F.when(size <= EXACT, size).otherwise(F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop))


def numbered(rows: DataFrame, by: str, order: list[str], part: Column, count: int, name: str) -> DataFrame:
    """rows with a gapless number from 0 within each value of `by`, given in parts (numbers part < some bound) that no task need hold together.

    `count`: of rows, so that a part has about PART_ROWS at most.
    """
    at, ahead = fresh(rows, "part"), fresh(rows, "ahead")
    parts = max(1, -(-count // PART_ROWS)) * 2
    rows = rows.withColumn(at, F.pmod(part, F.lit(parts)))
    before = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy(by, at).agg(F.count("*").alias("n")).withColumn(ahead, F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy(by, at).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(within) - 1).join(offset, [by, at]).withColumn(name, (F.col(name) + F.col(ahead)).cast("long")).drop(at, ahead)


def shard(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, group_sha256.

    Null texts form one group of size 1 each, with the crc32 of the empty text; null ids are numbered first; repeated ids keep
    their rows; an empty table gives an empty result.  Other columns are ignored, so their names cannot clash.
    """
    spark = docs.sparkSession
    stage = Stage(spark)
    text = F.col(text_col)
    keyed = stage.keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("n")).cast("binary"), 256)).alias("group_sha256"),
        ),
        "keyed",
    )
    total, rows = keyed.agg(F.sum("size"), F.count("*")).first()
    total, rows = total or 0, rows or 0
    groups = keyed.groupBy("group_sha256").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    alone = (F.col("bytes") * LARGE > total) | (F.col("n") * LARGE > rows)
    groups = stage.keep(groups.select("group_sha256", "bytes", F.when(alone, F.hex("group_sha256")).alias("own"), size_class(F.col("bytes")).alias("class")), "groups")
    own = groups.where("own is not null").select("own", "bytes").collect()  # under 2 LARGE rows
    classes = groups.where("own is null").groupBy("class").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()  # a row a size
    count = sum(r["n"] for r in classes)
    placed = lpt([(r["own"], r["bytes"], 1) for r in own] + [(f"c:{r['class']}", -(-r["bytes"] // r["n"]), r["n"]) for r in classes], n_shards)
    large = spark.createDataFrame([(r["own"], placed[r["own"]].index(1)) for r in own] or [("", 0)], "own string, shard int")
    # the groups of a size, in the order of their numbers, fill the shards one after the other; a row holds where each shard ends
    ends = spark.createDataFrame([(r["class"], np.cumsum(placed[f"c:{r['class']}"]).tolist()) for r in classes] or [(0, [0])], "class long, ends array<long>")
    small = numbered(groups.where("own is null").select("group_sha256", "class"), "class", ["group_sha256"], F.xxhash64("group_sha256", F.lit(3)), count, "number")
    small = small.join(F.broadcast(ends), "class").select("group_sha256", F.size(F.filter("ends", lambda e: e <= F.col("number"))).alias("shard"))
    # rows of large groups are told by a broadcast; the groups left have no more than a LARGE-th of the rows each
    told = keyed.join(F.broadcast(large.select(F.unhex("own").alias("group_sha256"), F.col("shard").alias("own"))), "group_sha256", "left")
    put = told.where("own is not null").withColumnRenamed("own", "shard").unionByName(told.where("own is null").drop("own").join(small, "group_sha256"))
    put = stage.keep(put.withColumn("row", F.monotonically_increasing_id()), "put")  # written, so a row keeps its number; equal rows have different ones
    slots = numbered(put, "shard", ["doc_id", "group_sha256", "row"], F.xxhash64("row", F.lit(3)), -(-rows // n_shards), "slot")
    stage.drop(keyed, groups)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.hex("group_sha256").alias("group_sha256"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
