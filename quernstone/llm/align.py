"""Alignment of two tokenizers over a corpus by packed pair keys.

A text's tokens of both tokenizers are byte ranges over the same bytes.  The sorted union of both sides' ends cuts the text into segments, each
inside one token of either side, so the segments are the pairs of overlapping tokens and no pair is ever searched for.  A pair of ids is one
64-bit key.  Counting takes np.unique over each partition, a global sort of these partial counts by ranges of keys, and a sum over runs
of equal keys.  Each range's sorted keys and counts become files in the shared folder, which the tasks that need counts
map into memory and search; the highest count of an id of B is a table bounded by its vocabulary.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import byte_chars, tokenizer_path
from .common import Stage, slices, small_batches, table

#: Links that a counting task gathers before it counts them, and distinct pairs that it holds before it passes them on.
GATHER = 1 << 20
HELD = 1 << 20
#: About so many partial counts make a shard.
SHARD_ROWS = 1 << 21
#: Texts in a row are aligned together up to about so many characters.
CHARS = 1 << 18
#: Fixed values, the splitting rule of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The fast splitter gives up on far longer runs of white space than this; texts that have one take the other library, which gives the same ids.
LONG_SPACE = 4096
WIDE = re.compile(r"\s{%d}" % LONG_SPACE)
#: A single space between two characters that aren't white space.
UNIT = re.compile(r" (?<=\S )(?=\S)")
#: Encoded units are kept up to so many characters (and a slice of texts more).
KNOWN_CHARS = 1 << 20


def listed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row and how many each list has."""
    many = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(many.sum())), many


class Lists:
    """A growing row of lists of ids."""

    def __init__(self):
        self.flat, self.start, self.many = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, many: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(many) - many])
        self.flat, self.many = np.concatenate([self.flat, ids]), np.concatenate([self.many, many])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists in a row, and how many each has."""
        many = self.many[at]
        before = np.cumsum(many) - many
        return self.flat[np.repeat(self.start[at] - before, many) + np.arange(int(many.sum()))], many


class Sides:
    """Both tokenizers: ids of a text, and the bytes and byte lengths of ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        # a token outside the byte alphabet is no text's token
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t) and not t.startswith("<|")}
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.path_a, self.library = path_a, None
        self.bytes_a = np.full(max(ranks.values()) + 1, b"", dtype=object)
        for raw, i in ranks.items():
            self.bytes_a[i] = raw
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.by_units = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.known: dict[str, int] = {}
        self.chars, self.store, self.fine = 0, [Lists() for _ in "ab"], np.zeros(0, dtype=bool)
        self.bytes_b = np.array([self._piece(i) for i in range(self.b.get_piece_size())], dtype=object)
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # with the sign that follows: inside a group, at its end (A: the B side follows), at the text's end
        self.word_a = np.array([f"{i}{s}" for s in ",|" for i in range(len(self.bytes_a))], dtype=object)
        self.word_b = np.array([f"{i}{s}" for s in (",", ";", "") for i in range(len(self.bytes_b))], dtype=object)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids_a(self, text: str) -> list[int]:
        if len(text) < LONG_SPACE or not WIDE.search(text):
            return self.a.encode_ordinary(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path_a)
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids

    def units(self, text: str) -> list[str]:
        """A text cut at its single spaces.  Both tokenizers begin a token at such a space, so units are encoded one by one and only once."""
        return UNIT.split(text) if self.by_units else [text]

    def row_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of a space and each unit, which have no white space at their ends: encoded in a row, parted where they end in bytes."""
        ids = np.array(self.ids_a(" " + " ".join(units)) if units else [], np.int32)
        stops = np.cumsum(np.fromiter((len(u.encode("utf-8", "replace")) + 1 for u in units), np.int64, len(units)))
        ends = np.cumsum(self.len_a[ids])
        at = np.searchsorted(ends, stops)
        if len(at) and (at[-1] >= len(ends) or (ends[at] != stops).any()):
            return listed([self.ids_a(f" {u}") for u in units])
        return ids, np.diff(at, prepend=-1)

    def ready(self, texts: list[list[str]]) -> None:
        """Makes all these units known; the store of known ones is emptied when it has grown to KNOWN_CHARS."""
        want = set(chain.from_iterable(texts))
        new = [u for u in want if u not in self.known]
        if self.chars > KNOWN_CHARS:
            self.known, self.chars, new = {}, 0, list(want)
            self.store = [Lists() for _ in "ab"]
            self.fine = np.zeros(0, dtype=bool)
        if not new:
            return
        self.chars += sum(map(len, new))
        plain = [u for u in new if u and u.strip() is u] if self.by_units else []
        odd = [u for u in new if not u or u.strip() is not u] if self.by_units else new
        new = plain + odd
        row, rest = self.row_a(plain), listed([self.ids_a(f" {u}") for u in odd])
        a = np.concatenate([row[0], rest[0]]), np.concatenate([row[1], rest[1]])
        raw = [f" {u}".encode("utf-8", "replace") for u in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        fine = np.ones(len(new), dtype=bool)
        for own, (ids, many), held, lens in ((self.store[0], a, self.bytes_a, self.len_a), (self.store[1], listed(self.b.encode(new, num_threads=1)), self.bytes_b, self.len_b)):
            own.add(ids, many)
            ends = np.cumsum(many)
            same = np.diff(np.concatenate(([0], np.cumsum(lens[ids])))[ends], prepend=0) == size
            if not same.all() or b"".join(held[ids].tolist()) != b"".join(raw):
                same = np.array([b"".join(held[x].tolist()) == r for x, r in zip(np.split(ids, ends[:-1]), raw, strict=True)])
            fine &= same
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.fine = np.concatenate([self.fine, fine])

    def encode_many(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of both sides: all ids in a row and how many each text has: none where it is empty or a side's bytes aren't a space and the text."""
        cut = [self.units(t) for t in texts]
        self.ready(cut)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64)
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cut), np.int64, len(cut)))
        good = np.fromiter(map(bool, texts), bool, len(texts))
        good[owner[~self.fine[at]]] = False
        kept = good[owner]
        at, owner = at[kept], owner[kept]
        out = []
        for own in self.store:
            ids, many = own.take(at)
            out.append((ids, np.bincount(owner, weights=many, minlength=len(texts)).astype(np.int64)))
        return out

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        (a, _), (b, _) = self.encode_many([text])
        return a.tolist(), b.tolist()

    def cut(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For tokens in a row: of each segment, the places of its tokens in a and b; and how many tokens of either side each group has."""
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        cuts = np.unique(np.concatenate([end_a, end_b]))
        at_a, at_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        both = np.flatnonzero((end_a[at_a] == cuts) & (end_b[at_b] == cuts)) if len(cuts) else cuts
        return at_a, at_b, np.diff(at_a[both], prepend=-1), np.diff(at_b[both], prepend=-1)


@functools.cache
def sides(path_a: str, path_b: str) -> Sides:
    """One for each pair of files and worker process."""
    return Sides(path_a, path_b)


def encode_batches(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    two = sides(path_a, path_b)
    for batch, texts in slices(batches, 1, CHARS):
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32()), pa.array(ids, pa.int32())) for ids, many in two.encode_many(texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "a", "b"])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All items of a list column and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b.astype(np.int64) << 32) | a


def parts(batches: Iterator[pa.RecordBatch], size: int = CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `size` tokens, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.cumsum(flat(batch.column(1))[1]) // size
        starts = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for s, e in zip(starts, starts[1:], strict=False):
            yield batch.slice(s, e - s)


def run_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys once each, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[start], np.add.reduceat(counts, start)


def count_batches(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """Partial counts of pairs."""
    two = sides(path_a, path_b)
    keys = counts = np.zeros(0, np.int64)
    waiting, n = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, c = np.unique(np.concatenate(waiting), return_counts=True)
        k, c = np.concatenate([keys, k]), np.concatenate([counts, c])
        by = np.argsort(k, kind="stable")
        return run_sums(k[by], c[by])

    def out() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], names=["key", "n"])

    for batch in parts(batches):
        a, b = flat(batch.column(1))[0], flat(batch.column(2))[0]
        at_a, at_b, _, _ = two.cut(a, b)
        waiting.append(pack(a[at_a], b[at_b]))
        n += len(at_a)
        if n >= GATHER:
            (keys, counts), waiting, n = merged(), [], 0
            if len(keys) >= HELD:
                yield from out()
                keys = counts = np.zeros(0, np.int64)
    if waiting:
        keys, counts = merged()
    yield from out()


# -- shards ---------------------------------------------------------------------------------------------------------------------


def local(uri: str) -> str | None:
    """The path of a folder that the machines mount, None for one in a store."""
    found = urlparse(uri)
    return found.path if found.scheme in ("", "file") else None


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _create(uri: str):
    path = local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    store, at = _store(uri)
    return store.open_output_stream(at)


@functools.lru_cache(maxsize=256)
def _mapped(uri: str) -> np.ndarray:
    return np.memmap(local(uri), dtype=np.int64, mode="r")


@functools.lru_cache(maxsize=4)
def _fetched(uri: str) -> np.ndarray:
    store, at = _store(uri)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype=np.int64)


def _longs(uri: str) -> np.ndarray:
    return _mapped(uri) if local(uri) is not None else _fetched(uri)


SHARD = "file string, least long, most long, n long, b array<int>, best array<long>"


def write_shard(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Sums the runs of one range of sorted keys into two files; a row says what they hold.

    Every attempt writes files of its own, and only the one that succeeds is named by a row.
    """
    name = f"{root}/{uuid.uuid4().hex}"
    least = most = None
    total, best = 0, {}
    last_key, last_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    with _create(f"{name}.keys") as kf, _create(f"{name}.counts") as cf:

        def put(k: np.ndarray, c: np.ndarray) -> None:
            nonlocal least, most, total
            if not len(k):
                return
            kf.write(k.tobytes())
            cf.write(c.tobytes())
            least, most, total = int(k[0]) if least is None else least, int(k[-1]), total + len(k)
            b = k >> 32
            start = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            for i, top in zip(b[start].tolist(), np.maximum.reduceat(c, start).tolist(), strict=True):
                best[i] = max(best.get(i, 0), top)

        for batch in batches:
            k = np.concatenate([last_key, batch.column(0).to_numpy(zero_copy_only=False)])
            c = np.concatenate([last_n, batch.column(1).to_numpy(zero_copy_only=False)])
            k, c = run_sums(k, c)
            put(k[:-1], c[:-1])  # the last run may go on in the next batch
            last_key, last_n = k[-1:], c[-1:]
        put(last_key, last_n)
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([least]), pa.array([most]), pa.array([total]), pa.array([list(best)], pa.list_(pa.int32())), pa.array([list(best.values())], pa.list_(pa.int64()))],
            names=["file", "least", "most", "n", "b", "best"],
        )


class Counts:
    """Counts of all pairs of the corpus: a row a shard on the driver, and each B id's highest count (as many as B has ids)."""

    def __init__(self, shards: list, n_b: int):
        shards = sorted(shards, key=lambda s: s["least"])
        self.files = [s["file"] for s in shards]
        self.most = np.array([s["most"] for s in shards], dtype=np.int64)
        self.best = np.zeros(n_b, dtype=np.int64)
        for s in shards:
            np.maximum.at(self.best, s["b"], s["best"])

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, all of which occur."""
        shard = np.searchsorted(self.most, keys)
        out = np.zeros(len(keys), np.int64)
        edges = np.flatnonzero(np.diff(shard, prepend=-1))
        for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True):
            file = self.files[shard[s]]
            out[s:e] = _longs(f"{file}.counts")[np.searchsorted(_longs(f"{file}.keys"), keys[s:e])]
        return out


def digest_batches(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, counts: Counts, keep: bool) -> Iterator[pa.RecordBatch]:
    two = sides(path_a, path_b)
    for batch in parts(batches):
        (a, many_a), (b, many_b) = flat(batch.column(1)), flat(batch.column(2))
        at_a, at_b, in_a, in_b = two.cut(a, b)
        keys, back = np.unique(pack(a[at_a], b[at_b]), return_inverse=True)
        n = counts.of(keys)
        top = (n == counts.best[keys >> 32])[back]
        n = n[back]
        # texts end where groups end: where each text's tokens, groups and links end
        stop_a, stop_b = np.cumsum(many_a), np.cumsum(many_b)
        stop_group = np.searchsorted(np.cumsum(in_a), stop_a, side="right") if len(in_a) else np.zeros(len(stop_a), np.int64)
        stop_link = np.searchsorted(at_a, stop_a)
        between = lambda x, stop: np.diff(np.concatenate(([0], np.cumsum(x)))[stop], prepend=0)
        # the words of a group: its A tokens, then its B tokens
        group_a, group_b = np.repeat(np.arange(len(in_a)), in_a), np.repeat(np.arange(len(in_b)), in_b)
        before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
        words = np.empty(len(a) + len(b), dtype=object)
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[np.cumsum(in_a) - 1] = 1
        ends_b[np.cumsum(in_b) - 1] = 1
        ends_b[stop_b[many_b > 0] - 1] = 2
        words[np.arange(len(a)) + before_b[group_a]] = two.word_a[a + ends_a * len(two.bytes_a)]
        words[np.arange(len(b)) + before_a[group_b]] = two.word_b[b + ends_b * len(two.bytes_b)]
        words, stop = words.tolist(), (stop_a + stop_b).tolist()
        texts = ["".join(words[s:e]) for s, e in zip([0, *stop], stop, strict=False)]
        hashed = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
        longs = [many_a, many_b, np.diff(stop_group, prepend=0), np.diff(stop_link, prepend=0), between(top.astype(np.int64), stop_link), between(n, stop_link)]
        cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in longs), pa.array(hashed, pa.string()), *([pa.array(texts, pa.string())] if keep else [])]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *LONGS, "groups_sha256", *(["groups"] if keep else [])])


LONGS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Alignment:
    """The alignment of two tokenizers over a table of texts.

    Null and empty texts, and those whose bytes a side doesn't give back, have no tokens.  Ids may be null or repeated, a row each; equal texts count
    each time.  An empty table has no pairs.  Long texts are whole; a task holds the tokens of one text at least.  Only the id and the text are read.
    """

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        self.paths = path_a, path_b
        self.stage = stage = Stage(spark)
        narrow = small_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
        self.tokens = stage.keep(narrow.mapInArrow(lambda it: encode_batches(it, path_a, path_b), "doc_id long, a array<int>, b array<int>"), "tokens")
        partial = stage.keep(self.tokens.mapInArrow(lambda it: count_batches(it, path_a, path_b), "key long, n long"), "partial")
        root = f"{stage.root}/pairs"
        n = -(-partial.count() // SHARD_ROWS)
        by_key = partial.repartitionByRange(max(n, 1), "key").sortWithinPartitions("key")
        shards = by_key.mapInArrow(lambda it: write_shard(it, root), SHARD).collect()
        stage.drop(partial)
        self.counts = Counts(shards, len(sides(path_a, path_b).bytes_b))

    def pairs(self) -> DataFrame:
        """a_id, b_id and count of every pair that occurs; a task a shard."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file in batch.column(0).to_pylist():
                    keys, n = _longs(f"{file}.keys"), _longs(f"{file}.counts")
                    for i in range(0, len(keys), 1 << 16):
                        k = np.asarray(keys[i : i + (1 << 16)])
                        yield pa.RecordBatch.from_arrays([pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array((k >> 32).astype(np.int32)), pa.array(np.asarray(n[i : i + (1 << 16)]))], names=["a_id", "b_id", "n"])

        files = self.stage.spark.createDataFrame([(f,) for f in self.counts.files], "file string")
        return files.repartition(max(1, len(self.counts.files))).mapInArrow(rows, "a_id int, b_id int, n long")

    def documents(self, keep_groups: bool = False) -> DataFrame:
        """Of each document: tokens, groups, links, best links, the sum of the links' counts, the digest of its groups and, if wanted, the groups."""
        (path_a, path_b), counts = self.paths, self.counts
        schema = ", ".join(["doc_id long", *(f"{c} long" for c in LONGS), "groups_sha256 string", *(["groups string"] if keep_groups else [])])
        return self.tokens.mapInArrow(lambda it: digest_batches(it, path_a, path_b, counts, keep_groups), schema)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).documents()
