"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A letter trigram's vector binds (multiplies) the letters' vectors, the first
permuted twice and the second once by a cyclic shift; a document bundles (adds) its trigrams' vectors; a language's
prototype bundles the unit vectors of its training documents.  The language whose prototype has the largest cosine wins.
Word bounds count as a letter of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, bounded_sample, codes, crc_mod, slices, small_batches, table

DIMS = 1024
SEED = 20_011
PER_LANGUAGE = 1500
BLOCK = 4096
#: Prototypes of about so many languages are held at once, by the driver and by a task.
LANGUAGES = 1024
#: Up to so many trigrams of a slice's own symbols are counted in a table, beyond that by sorting.
DENSE = 1 << 22
SCALE = float(1 << 20)

_tables: dict[str, np.ndarray] = {}


def symbols() -> np.ndarray:
    """Symbol of each code point: a letter is its own, whatever its script; 0 is for what is no letter."""
    if "symbols" not in _tables:
        _tables["symbols"] = np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.int64, 0x110000)
    return _tables["symbols"]


def letters(which: np.ndarray) -> np.ndarray:
    """A vector of +1 and -1 for each of these symbols: the bits of a 64-bit mix of symbol, seed and place."""
    places = np.arange(DIMS // 64, dtype=np.uint64)
    x = (which.astype(np.uint64)[:, None] * np.uint64(DIMS // 64) + places + np.uint64(SEED << 32)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


def distinct(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys below `size`, and each key's place among them."""
    if size > DENSE:
        return np.unique(key, return_inverse=True)
    there = np.zeros(size, dtype=bool)
    there[key] = True
    found = np.flatnonzero(there)
    column = np.zeros(size, dtype=np.int32)
    column[found] = np.arange(len(found))
    return found, column[key]


def profiles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bundled vector (float32) and its number of letters."""
    points, starts = codes([t.lower() for t in texts])
    sym = symbols()[points].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    keep = (sym != 0) | np.concatenate(([True], sym[:-1] != 0))  # one word bound for any run of other characters
    sym, doc = np.concatenate(([0], sym[keep])), np.concatenate(([0], doc[keep]))
    at = np.flatnonzero(sym)
    n_letters = np.bincount(doc[at], minlength=len(texts))
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    if not len(at):
        return out, n_letters
    there = np.zeros(len(symbols()), dtype=np.int32)
    there[sym] = 1
    own = np.flatnonzero(there)  # this slice's symbols; the word bound, 0, is the first
    there[own] = np.arange(len(own))
    n, rank = len(own), there[sym].astype(np.int64)
    grams, col = distinct((rank[at - 1] * n + rank[at]) * n + rank[at + 1], n**3)
    owner = doc[at]
    base = letters(own)
    first, second = np.roll(base, 2, 1), np.roll(base, 1, 1)
    for low in range(0, len(grams), BLOCK):
        part = grams[low : low + BLOCK]
        if len(grams) > BLOCK:
            here = (col >= low) & (col < low + BLOCK)
            c, o = col[here] - low, owner[here]
        else:
            c, o = col, owner
        counts = np.bincount(o * len(part) + c, minlength=len(texts) * len(part)).reshape(len(texts), len(part)).astype(np.float32)
        out += counts @ (first[part // (n * n)] * second[part // n % n] * base[part % n]).astype(np.float32)
    return out, n_letters


def unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return v / np.where(size > 0, size, 1)


def bundle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to each slice's bundles: (lang, position, value scaled to integers so that sums are exact)."""
    for batch, texts in slices(batches, 1, each=4096):
        vec, n = profiles(texts)
        vec = np.rint(unit(vec) * SCALE).astype(np.int64)
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for lang in sorted(set(langs[n > 0].tolist())):
            total = vec[(langs == lang) & (n > 0)].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMS, pa.string()), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(total)], names=["lang", "at", "value"])


def bundles(labelled: DataFrame) -> DataFrame:
    """(lang, at, value): each language's bundle from rows (lang, text), a row a dimension."""
    return small_batches(labelled).mapInArrow(bundle_batches, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))


def prototypes(sums: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes (unit vectors); DIMS rows a language come to the driver."""
    rows = sums.toArrow()
    coded = rows["lang"].combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    rank = {x: i for i, x in enumerate(langs)}
    which = np.array([rank[x] for x in names], dtype=np.int64)[coded.indices.to_numpy()]
    proto = np.zeros((len(langs), DIMS))
    proto[which, rows["at"].to_numpy()] = rows["value"].to_numpy()
    return langs, unit(proto)


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes from rows (lang, text), where the languages are few."""
    return prototypes(bundles(labelled))


def nearest(rows: DataFrame, langs: list[str], proto: np.ndarray) -> DataFrame:
    """The columns of rows but `text`, with lang_pred and score among these languages."""
    at = rows.columns.index("text")
    names = [c for c in rows.columns if c != "text"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, at, each=4096):
            vec, n = profiles(texts)
            lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            if langs:
                cos = unit(vec) @ proto.T
                best, known = cos.argmax(axis=1), n > 0
                lang[known] = np.array(langs, dtype=object)[best[known]]
                score[known] = np.clip(cos[np.arange(len(best)), best], 0.0, 1.0)[known]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return small_batches(rows).mapInArrow(run, schema)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of (doc_id, text, lang).

    Rows whose crc32(doc_id) mod 4 is 2 are held out; the prototypes come from about `per_language` of the other rows of each
    language; rows equal in id, language and text count once in learning.  Null texts and texts without a letter are `und` with score 0, as is everything where nothing could be learned.
    Ties go to the first language in order.  Ids may be null or repeated; an empty table gives no rows; a text has no greatest length.  Other columns are not read.

    The prototypes are a table.  About `languages` of them are held at once: beyond that the numbered texts are written once and read for each
    block of languages, which gives a row a text with its best of the block; a text's best of all is an aggregate over its rows.
    """
    held = crc_mod("doc_id", 4) == 2
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    some = bounded_sample(known.withColumn("h", F.xxhash64("text")), "lang", ["doc_id", "h"], per_language)
    stage = Stage(docs.sparkSession)
    sums = stage.keep(bundles(some.select("lang", "text")), "prototypes")
    many = -(-sums.where("at = 0").count() // languages)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    if many <= 1:
        return nearest(rows, *prototypes(sums))
    rows = stage.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = [stage.keep(nearest(rows, *prototypes(sums.where(F.pmod(F.xxhash64("lang"), F.lit(many)) == k))), "nearest") for k in range(many)]
    unknown = (F.col("lang_pred") == "und") & (F.col("score") == 0)
    best = F.min(F.struct(unknown.alias("unknown"), (-F.col("score")).alias("less"), "lang_pred"))
    return (
        functools.reduce(DataFrame.unionByName, found)
        .groupBy("row", "doc_id", "held_out")
        .agg(best.alias("best"))
        .select("doc_id", "held_out", F.col("best.lang_pred").alias("lang_pred"), (-F.col("best.less")).alias("score"))
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
