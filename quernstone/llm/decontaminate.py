"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a text with at most e edits shares at least m + 1 - q (e + 1) q-grams with it, all on
diagonals (text position less item position) no more than 2 e apart.  For each text, hits of its q-grams in the items' index are counted
in overlapping diagonal bands, twice 2 e + 1 wide and half overlapping, so that some band holds all hits of an occurrence.
Only bands that reach the bound are kept, and each is verified by a banded alignment of the item with that stretch of text (where the
item stands there unchanged, comparing symbols is that alignment).

Texts and items are compared as lower-case letters and digits with single spaces.  e is 8 % of m, rounded down, for every item.  q is 8, or
for an item with which that gives no positive bound the largest q that does, m div (e + 1); so items of 1 to 7 characters (e = 0) are
looked up as one q-gram, and must stand as whole words.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, attach, codes, fresh, table

Q = 8
EDITS = 0.08
#: So many pairs of positions and runs of offsets are counted at a time; so many alignments are kept while a slice of texts is searched.
PAIRS = 1 << 18
SEEN = 512
#: Items are sent to the executors in parts of so many characters; each part is a pass over the documents.
PART_CHARS = 2_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def folded() -> np.ndarray:
    """Each code point's lower-case letter or digit, or a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each text followed by one space; where each starts; and each symbol's place in its own text."""
    points, starts = codes(texts)
    sym = folded()[points]
    keep = np.ones(len(sym), dtype=bool)
    keep[1:] = (sym[1:] != 32) | (sym[:-1] != 32)
    keep[starts[:-1]] = sym[starts[:-1]] != 32  # none at a text's start
    last = starts[1:] - 1
    keep[last] = True
    keep[last[1:]] |= True
    place = np.flatnonzero(keep)
    # the newline after a text is kept as its one closing space, so a space before it goes
    double = np.zeros(len(place), dtype=bool)
    closing = np.searchsorted(place, last)
    before = closing - 1
    ok = (before >= 0) & (sym[place[before]] == 32) & (place[before] >= starts[:-1])
    double[before[ok]] = True
    place = place[~double]
    first = np.searchsorted(place, starts)
    owner = np.repeat(starts[:-1], np.diff(first))
    return sym[place], first, place - owner


def grams(sym: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q symbols from each position."""
    n = len(sym) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    s = sym.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(q):
        h *= PRIME
        h += s[k : k + n]
    return (h ^ (h >> np.uint64(31))) * PRIME


def equal_at(stretch: np.ndarray, p: np.ndarray) -> int:
    """The first place where p stands in a stretch as it is, or -1."""
    text, part = stretch.tobytes(), p.tobytes()
    at = text.find(part)
    while at % 4 and at >= 0:  # a symbol has four bytes
        at = text.find(part, at + 1)
    return at // 4 if at >= 0 else -1


class Index:
    """The q-grams of some items: for each q and hash the items and offsets where it stands."""

    def __init__(self, items: tuple[tuple[int | None, str], ...], q: int = Q, edits: float = EDITS):
        sym, first, _ = normal([t for _, t in items])
        self.ids = [i for i, _ in items]
        self.sym = [sym[a : b - 1] for a, b in zip(first, first[1:], strict=False)]
        self.size = np.array([len(s) for s in self.sym], dtype=np.int64)
        self.budget = np.floor(self.size * edits + 1e-9).astype(np.int64)
        self.q = np.minimum(q, self.size // (self.budget + 1))
        self.bound = self.size + 1 - self.q * (self.budget + 1)
        self.width = 2 * self.budget + 1
        self.whole = (self.size < q) & (self.budget == 0)  # these stand as whole words
        self.by_q = [(int(n), *self._grams(np.flatnonzero(self.q == n), int(n))) for n in np.unique(self.q[self.size > 0])]

    def _grams(self, items: np.ndarray, q: int) -> tuple[np.ndarray, ...]:
        own = [grams(self.sym[k], q) for k in items.tolist()]
        h = np.concatenate(own)
        item = np.repeat(items, [len(x) for x in own])
        offset = np.concatenate([np.arange(len(x)) for x in own])
        by = np.lexsort((offset, item, h))
        h, item, offset = h[by], item[by], offset[by]
        # offsets of one item that lie within a band's width of each other are one run: they give neighbouring bands
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1]) | (np.diff(offset) > self.width[item[1:]])
        run = np.flatnonzero(new)
        low, high = offset[run], offset[np.concatenate((run[1:], [len(h)])) - 1]
        hashes, start, many = np.unique(h[run], return_index=True, return_counts=True)
        shift = np.uint64(64 - min(max(16, len(hashes).bit_length() + 3), 26))  # about one in eight places is taken
        there = np.zeros(1 << (64 - int(shift)), dtype=bool)
        there[(hashes >> shift).astype(np.int64)] = True
        return item[run], low, high, hashes, start, many, there, shift

    def hits(self, sym: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Text, item, position and least and greatest offset of every q-gram of a text and run of the same q-gram in an item, PAIRS or so at a time."""
        for q, items, low, high, hashes, start, many, there, shift in self.by_q:
            h = grams(sym, q)
            at = np.flatnonzero(there[(h >> shift).astype(np.int64)])
            k = np.searchsorted(hashes, h[at])
            k[k == len(hashes)] = 0
            hit = hashes[k] == h[at]
            at, k = at[hit], k[hit]
            doc = np.searchsorted(first, at, side="right") - 1
            inside = at + q <= first[doc + 1] - 1  # not over a text's end
            at, k, doc = at[inside], k[inside], doc[inside]
            del h, hit, inside
            cut = np.cumsum(many[k]) // PAIRS
            edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(at)]
            for a, b in zip(edges, edges[1:], strict=False):
                n = many[k[a:b]]
                which = np.repeat(start[k[a:b]], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                yield np.repeat(doc[a:b], n), items[which], np.repeat(at[a:b], n), low[which], high[which]

    def bands(self, first: np.ndarray, found: Iterator[tuple[np.ndarray, ...]]) -> list[tuple[int, int, int]]:
        """(text, item, band) that reach the bound; band b of an item holds diagonals from b * width to (b + 2) * width.

        A position of a text counts once for every band that it shares a q-gram with the item in, however often the item repeats that, as the lemma
        needs no more.  It adds one where its bands begin and takes it away after they end, and these changes are summed up piece by piece.
        """
        shift = int(self.size.max(initial=0)) + 3
        n_band = int(np.diff(first).max(initial=0)) + 2 * shift + 4
        keys, change = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for doc, item, pos, low, high in found:
            at, width = pos - first[doc], self.width[item]
            pair = (doc * len(self.ids) + item) * n_band + shift
            begin, end = pair + np.floor_divide(at - high, width) - 1, pair + np.floor_divide(at - low, width) + 1
            keys, back = np.unique(np.concatenate((keys, begin, end)), return_inverse=True)
            one = np.ones(len(begin), np.int64)
            change = np.bincount(back, weights=np.concatenate((change, one, -one)), minlength=len(keys)).astype(np.int64)
        counts = np.cumsum(change)
        reach = np.flatnonzero(counts >= self.bound[keys // n_band % len(self.ids)])
        reach = reach[counts[reach] > 0]
        many = keys[np.minimum(reach + 1, len(keys) - 1)] - keys[reach]
        every = np.repeat(keys[reach] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        pair, band = every // n_band, every % n_band - shift
        return list(zip((pair // len(self.ids)).tolist(), (pair % len(self.ids)).tolist(), band.tolist(), strict=True))

    def align(self, stretch: np.ndarray, item: int, before: int = 0) -> tuple[int, int, int]:
        """Least edits of the item against any part of a stretch of text that begins on one of its len(stretch) - m + 1 + e first
        places, with the part's start and end.  A row for each symbol of the item holds the diagonals of the band only; `before` of them lie before
        the stretch, for symbols that are missing where a text begins with the item.
        """
        p, n = self.sym[item], len(stretch)
        m = len(p)
        same = equal_at(stretch, p)
        if same >= 0:  # the alignment without edits
            return 0, same, same + m
        wide = before + max(n - m, 0) + int(self.budget[item]) + 1
        far = np.int32(m + n + 1)
        text = np.full(before + n + m + wide, 0x7FFFFFFF, dtype=np.uint32)  # beyond the stretch nothing is equal
        text[before : before + n] = stretch
        idx = np.arange(wide, dtype=np.int32)
        row, since = np.zeros(wide, dtype=np.int32), idx.copy()
        up, came = np.empty(wide, dtype=np.int32), np.empty(wide, dtype=np.int32)
        for i in range(m):
            cost = row + (text[i : i + wide] != p[i])
            up[:-1], up[-1] = row[1:] + 1, far
            came[:-1], came[-1] = since[1:], 0
            less = up < cost
            cost, since = np.where(less, up, cost), np.where(less, came, since)
            flat = cost - idx
            best = np.minimum.accumulate(flat)  # then symbols of the text that the item lacks, along the row
            since = since[np.maximum.accumulate(np.where(flat == best, idx, 0))]
            row = best + idx
        row = np.where(idx + m <= before + n, row, far)
        end = int(row.argmin())
        return int(row[end]), max(0, int(since[end]) - before), end + m - before

    def find(self, texts: list[str]) -> list[list[tuple[int | None, int, int, int]]]:
        """For each text: (item id or None, start, end, edits) of what was found, places in the text itself; the best of each item and stretch."""
        sym, first, place = normal(texts)
        out: list[dict] = [{} for _ in texts]

        def to_align() -> Iterator[tuple[np.ndarray, ...]]:
            for doc, item, pos, low, high in self.hits(sym, first):
                word = self.whole[item]
                if word.any():
                    self._whole_words(sym, first, place, doc[word], item[word], pos[word], out)
                yield tuple(x[~word] for x in (doc, item, pos, low, high))

        self._aligned(sym, first, place, self.bands(first, to_align()), out)
        return [sorted(((self.ids[i], s, e, d) for (i, s, e), d in x.items()), key=lambda r: (r[0] is None, r[0] or 0, *r[1:])) for x in out]

    def _whole_words(self, sym, first, place, doc, item, pos, out) -> None:
        end = pos + self.size[item]
        fine = (sym[end] == 32) & ((pos == first[doc]) | (sym[np.maximum(pos - 1, 0)] == 32))
        doc, item, pos, end = doc[fine], item[fine], pos[fine], end[fine]
        for d, k, s, t in zip(doc.tolist(), item.tolist(), place[pos].tolist(), (place[end - 1] + 1).tolist(), strict=True):
            out[d][k, s, t] = 0

    def _aligned(self, sym, first, place, bands, out) -> None:
        stretches: list[list[int]] = []
        for doc, item, band in bands:
            if stretches and stretches[-1] == [doc, item, band - 1, band - 1]:
                stretches[-1][3] = band  # two neighbours that overlap are aligned once
            else:
                stretches.append([doc, item, band, band])
        seen: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}
        for doc, item, band, upto in stretches:
            w, m, e = int(self.width[item]), int(self.size[item]), int(self.budget[item])
            a, b = int(first[doc]), int(first[doc + 1]) - 1
            low, high = max(a, a + band * w - e), min(b, a + (upto + 2) * w + m + e)
            if high - low < m - e:
                continue
            stretch = sym[low:high]
            ahead = min(e, max(0, e - band * w))
            known = (item, ahead, stretch.tobytes())  # repetitive texts have the same stretches over and over
            if known not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen[known] = self.align(stretch, item, ahead)
            edits, s, t = seen[known]
            if edits <= e and t > s:
                found = (int(place[low + s]), int(place[low + t - 1]) + 1)
                key = (item, *found)
                out[doc][key] = min(out[doc].get(key, e), edits)


@functools.lru_cache(maxsize=2)
def index(items: tuple[tuple[int | None, str], ...], q: int, edits: float) -> Index:
    """One index for each part of the benchmark and worker process."""
    return Index(items, q, edits)


def parts(benchmark: DataFrame, chars: int = PART_CHARS) -> Iterator[tuple[tuple[int | None, str], ...]]:
    """The items with text, in parts of about so many characters; one part at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // chars)
    for i in range(n):
        yield tuple((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text").collect())


def with_regions(docs: DataFrame, benchmark: DataFrame, name: str = "regions", q: int = Q, edits: float = EDITS, part_chars: int = PART_CHARS) -> DataFrame:
    """docs with a new column: array of (item, start, end, edits); a pass for each part of the benchmark, no shuffle.

    Empty and null texts have none; an empty benchmark finds none; items whose text is null or without a letter or digit are ignored,
    those without an id are searched too (null in the region's item), equal items each; of an item that stands more than once in a text each place
    has a region, but of places that lie in one stretch of neighbouring bands only the best.  Offsets are code points of the text, the end
    exclusive.  One part is on the driver at a time.  With several parts the rows are written once under a number each; a part's pass reads numbers and texts
    and writes the numbers and regions of the rows that hold something, and these are joined with the rows at the end.
    """
    kind = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
    sql = "array<struct<item:bigint,start:bigint,end:bigint,edits:bigint>>"
    names = ("item", "start", "end", "edits")
    none = F.array().cast(sql)

    def searched(rows: DataFrame, part: tuple) -> DataFrame:
        def compute(texts: list[str]) -> list:
            return [[[dict(zip(names, r, strict=True)) for r in rs] for rs in index(part, q, edits).find(texts)]]

        return attach(rows, [(name, sql, kind)], compute)

    some = parts(benchmark, part_chars)
    first, second = next(some, None), next(some, None)
    if first is None:
        return docs.withColumn(name, none)
    if second is None:
        return searched(docs, first)
    stage, key = Stage(docs.sparkSession), fresh(docs, "row_number")
    rows = stage.keep(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    for part in itertools.chain((first, second), some):
        stage.append(searched(rows.select(key, "text"), part).where(F.size(name) > 0).select(key, name), "regions")
    found = stage.read("regions", f"`{key}` long, `{name}` {sql}").groupBy(key).agg(F.flatten(F.collect_list(name)).alias(name))
    out = rows.join(found, key, "left")
    return out.select(*docs.columns, F.coalesce(F.col(name), none).alias(name))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, all columns as they are.

    Rows with null or empty texts stay; equal texts share their fate; an empty table stays empty and an empty benchmark takes nothing.
    Ids may be null or repeated; other columns, whatever their names, are not read.
    """
    name = fresh(docs, "regions")
    return with_regions(docs, benchmark, name).where(F.size(name) == 0).drop(name)


def decontaminate(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS) -> DataFrame:
    """doc_id, contaminated (0 or 1), n_items, items (ids in order), regions (item:start:end:edits, comma-joined) of each document.

    Items without an id count as one more item, null.  Null and empty texts are not contaminated; ids may be null or repeated, a row each; an
    empty table gives no rows.  Other columns are not read.
    """
    found = with_regions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, "regions", q, edits)
    items = F.array_sort(F.array_distinct(F.transform("regions", lambda r: r["item"])))
    said = F.array_join(F.transform(F.array_sort("regions"), lambda r: F.concat_ws(":", F.coalesce(r["item"].cast("string"), F.lit("null")), r["start"], r["end"], r["edits"])), ",")
    return found.select("doc_id", (F.size("regions") > 0).cast("int").alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"), said.alias("regions"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
