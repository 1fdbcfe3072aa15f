"""BPE encoding and decoding by speculation and verification.

A word's encoding is proposed by greedy longest match.  It is the merge procedure's own result exactly when every adjacent pair of
its tokens is compatible: undoing the merges of both tokens in reverse order never shows a merge across the seam that would
have come first.  That test runs on numpy arrays over all pairs not seen before; only words with an incompatible pair are
merged step by step.

Letter case, composition and letter classes come from this Python's Unicode tables.  The library has later ones, so runs with a character that
these tables don't have, or have otherwise, are normalised and split by the library itself; proposing, verifying and merging are the same for them.

The splitting rule of the vocabulary never lets a token cross white space (and neither canonical composition nor case mapping does),
so the unit of work and of caching is a run without white space.  Caches are bounded and belong to a worker process.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import slices, small_batches, table

SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The splitting pattern of the vocabulary file; letters are lower case when it is applied.
#: A newline, which no run holds, separates runs.
PIECES_ASCII = re.compile(rb"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
PIECES = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
RUNS = re.compile(f"[^{SPACE}]+")
END = "</w>"
#: The cache starts anew beyond so many runs or characters, twice over; longer runs than LONG_RUN are forgotten with the next slice.
CACHED_RUNS, CACHED_CHARS, LONG_RUN = 250_000, 1 << 24, 1024
LONG = 192
NONE = 1 << 30


#: Marks whose order among marks the library's tables give otherwise.
ODD_MARKS = "\u1df6\U0001e4ec\U0001e4ed"


#: What odd_places() knows of a code point: 0 nothing yet, 1 common, 2 odd.
KINDS = np.zeros(0x110000, dtype=np.uint8)


def odd_places(points: np.ndarray) -> np.ndarray:
    """Which code points are unassigned in this Python's Unicode tables, or odd marks; each is looked up once a worker process."""
    kinds = KINDS[points]
    for c in np.unique(points[kinds == 0]).tolist():
        KINDS[c] = 2 if unicodedata.category(chr(c)) == "Cn" or chr(c) in ODD_MARKS else 1
    return (kinds if kinds.all() else KINDS[points]) == 2


def byte_chars() -> list[str]:
    """Fixed values, by rule: the printable stand-in of each byte: itself where it prints in Latin-1, else the next code point from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def places_in_rows(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... many[i] of them, for each i in turn."""
    stop = np.cumsum(many)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - many), many)


class Rows:
    """Rows of ids in one flat array; rows are added at the end and cut off there."""

    def __init__(self):
        self.flat, self.end = np.zeros(1 << 10, np.int32), np.zeros(1 << 8, np.int64)
        self.n = 0

    def __len__(self) -> int:
        return self.n

    def add(self, flat: np.ndarray, many: np.ndarray) -> None:
        used, n = self.used(), self.n + len(many)
        if n > len(self.end):
            self.end = np.concatenate([self.end[: self.n], np.zeros(2 * n - self.n, np.int64)])
        if used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:used], np.zeros(used + 2 * len(flat), np.int32)])
        self.flat[used : used + len(flat)] = flat
        self.end[self.n : n] = used + np.cumsum(many)
        self.n = n

    def used(self) -> int:
        return int(self.end[self.n - 1]) if self.n else 0

    def many(self, at: np.ndarray) -> np.ndarray:
        return self.end[at] - self._start(at)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these rows in a row, and how many each has."""
        start = self._start(at)
        many = self.end[at] - start
        return self.flat[places_in_rows(start, many)], many

    def cut(self, n: int) -> None:
        """Only the first n rows stay; room that long ones took is given back."""
        self.n = n
        if len(self.flat) > 4 * self.used() + (1 << 20):
            self.flat = self.flat[: self.used()].copy()

    def _start(self, at: np.ndarray) -> np.ndarray:
        return np.where(at > 0, self.end[at - 1], 0)


class Encoder:
    """Encodes runs of non-space text with the vocabulary of one tokenizer file (BPE with word ends, byte level, lower case).

    A piece is an array of symbols: its bytes, the last one plus 256.  Tokens have own numbers here: first those that no merge
    makes, then those that merges make, in the order of the merges.
    """

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = {a + b for a, b in pairs}
        order = sorted(t for t in vocab if t not in made) + [a + b for a, b in pairs]
        self.n_base = len(order) - len(pairs)
        self.ids = np.array([vocab[t] for t in order], dtype=np.int32)
        self.content = {i: t for t, i in vocab.items()}
        index = {t: i for i, t in enumerate(order)}
        l = np.array([index[a] for a, _ in pairs], dtype=np.int64)
        r = np.array([index[b] for _, b in pairs], dtype=np.int64)
        own = np.arange(len(order), dtype=np.int64)
        self.left, self.right = own.copy(), own.copy()
        self.left[self.n_base :], self.right[self.n_base :] = l, r
        keys = (l << 20) | r
        by = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[by], by.astype(np.int64) + self.n_base
        self.merge_of = {int(k): self.n_base + i for i, k in enumerate(keys)}
        self._trie(order)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.content |= {i: t for t, i in self.special.items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.digits = pa.array(map(str, range(max(self.content) + 1)), pa.string())
        #: The cache: where each run's ids are among the rows; and those of before it last started anew.
        self.runs: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.rows, self.older_rows = Rows(), Rows()
        self.long: list[str] = []
        self.chars = 0
        self.counts = {"pieces": 0, "merged": 0}

    def _trie(self, order: list[str]) -> None:
        """All tokens as paths of symbols: sorted edges (node, symbol), the nodes they lead to, and the token that ends at a node."""
        byte_of = self.byte_of = {c: b for b, c in enumerate(byte_chars())}
        edges: dict[int, int] = {}
        ends = {}
        for t, text in enumerate(order):
            last = text.endswith(END) and text != END
            sym = [byte_of[c] for c in (text[: -len(END)] if last else text)]
            if last:
                sym[-1] += 256
            node = 0
            for x in sym:
                node = edges.setdefault((node << 9) | x, len(edges) + 1)
            ends[node] = t
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        by = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[by], (by + 1).astype(np.int64)
        self.token_at = np.full(len(edges) + 1, -1, dtype=np.int64)
        self.token_at[list(ends)] = list(ends.values())
        at = np.searchsorted(self.edge_keys, np.arange(512)).clip(max=len(keys) - 1)
        self.unit = np.where(self.edge_keys[at] == np.arange(512), self.token_at[self.edge_to[at]], -1)

    # -- proposing and verifying ------------------------------------------------------------------------------------------

    def propose(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over all pieces at once: their tokens in a row, and how many each piece has."""
        stop = np.cumsum(size)
        at = stop - size
        lane, node, far = np.arange(len(size)), np.zeros(len(size), np.int64), at.copy()
        best = np.full(len(size), -1, np.int64)
        best_end = at.copy()
        lanes, tokens = [], []
        while len(lane):
            inside = far < stop
            key = (node << 9) | sym[np.where(inside, far, 0)]
            e = np.searchsorted(self.edge_keys, key)
            e[e == len(self.edge_keys)] = 0
            go = inside & (self.edge_keys[e] == key)
            node = np.where(go, self.edge_to[e], 0)
            far = far + go
            tok = self.token_at[node]
            hit = go & (tok >= 0)
            best = np.where(hit, tok, best)
            best_end = np.where(hit, far, best_end)
            if not go.all():
                out = ~go
                lanes.append(lane[out])
                tokens.append(best[out])
                far = np.where(out, best_end, far)
                left = ~(out & (best_end >= stop))
                lane, node, far, best, best_end, stop = lane[left], node[left], far[left], best[left], best_end[left], stop[left]
        lanes, tokens = np.concatenate(lanes or [lane]), np.concatenate(tokens or [lane])
        by = np.argsort(lanes, kind="stable")
        return tokens[by], np.bincount(lanes, minlength=len(size))

    def verify(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of tokens stand side by side in a merge procedure's own result."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), dtype=bool)
        bound = np.full(len(a), NONE)  # a merge over the seam counts only if made before this
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            first = self.joined(x, y) < bound[live]
            ok[live[first]] = False
            live, x, y = live[~first], x[~first], y[~first]
            # undo the later of the two merges; of equal ones the right-hand token's, as the left-hand copy is merged first
            lx, ly = x >= self.n_base, y >= self.n_base
            undo_x = lx & ((x > y) | ~ly)
            undo_y = ly & ~undo_x
            bound[live[undo_x]] = x[undo_x]
            bound[live[undo_y]] = y[undo_y] + 1
            a[live[undo_x]] = self.right[x[undo_x]]
            b[live[undo_y]] = self.left[y[undo_y]]
            live = live[undo_x | undo_y]
        return ok

    def joined(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The token that a merge makes of each pair, or NONE."""
        key = (x << 20) | y
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (x >= 0) & (y >= 0), self.pair_made[at], NONE)

    def merge_many(self, toks: np.ndarray) -> np.ndarray:
        """The merge procedure on rows of tokens filled up with -1: in each row the earliest merge, leftmost among equal ones."""
        toks = toks.copy()
        n, width = toks.shape
        if width < 2:
            return toks
        made = self.joined(toks[:, :-1].ravel(), toks[:, 1:].ravel()).reshape(n, width - 1)
        made = np.column_stack([made, np.full(n, NONE)])  # a row's last place has no right-hand neighbour
        rows, place = np.arange(n), np.arange(width)
        while True:
            j = made[rows].argmin(axis=1)
            m = made[rows, j]
            some = m < NONE
            rows, j, m = rows[some], j[some], m[some]
            if not len(rows):
                return toks
            take = np.minimum(place[None, :] + (place[None, :] > j[:, None]), width - 1)
            t, g = np.take_along_axis(toks[rows], take, 1), np.take_along_axis(made[rows], take, 1)
            t[:, -1], g[:, -1] = -1, NONE
            k = np.arange(len(rows))
            t[k, j] = m
            after = np.where(j + 1 < width, t[k, np.minimum(j + 1, width - 1)], -1)
            g[k, j] = self.joined(m, after)
            before = j > 0
            g[k[before], j[before] - 1] = self.joined(t[k[before], j[before] - 1], m[before])
            toks[rows], made[rows] = t, g

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The same for one long piece: a heap of (merge, place) in one number each, over linked tokens in flat arrays."""
        n = len(sym)
        toks, after, before = array("q", self.unit[sym].tobytes()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        first = self.joined(self.unit[sym[:-1]], self.unit[sym[1:]])
        at = np.flatnonzero(first < NONE)
        heap = ((first[at] << 40) | at).tolist()
        made, alive = self.merge_of, bytearray(b"\x01") * n
        heapq.heapify(heap)
        while heap:
            m, i = divmod(heapq.heappop(heap), 1 << 40)
            j = after[i] if alive[i] else n
            if j >= n or made.get((toks[i] << 20) | toks[j]) != m:
                continue  # its tokens have merged with others since
            toks[i], alive[j], k = m, 0, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (v := made.get((m << 20) | toks[k])) is not None:
                    heapq.heappush(heap, (v << 40) | i)
            h = before[i]
            if h >= 0 and (v := made.get((toks[h] << 20) | m)) is not None:
                heapq.heappush(heap, (v << 40) | h)
        return np.frombuffer(toks, dtype=np.int64)[np.frombuffer(alive, dtype=np.uint8) > 0]

    def encode_symbols(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces in a row, and how many each piece has."""
        if not len(size):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.cumsum(size) - size
        long = size > LONG
        if long.any():  # walked one by one: a step for each symbol of the longest piece would hold all others up
            rest = np.repeat(~long, size)
            flat, many = self.encode_symbols(sym[rest], size[~long])
            own = [self.merge_long(sym[start[i] : start[i] + size[i]]) for i in np.flatnonzero(long)]
            out = np.zeros(len(size), np.int64)
            out[~long], out[long] = many, [len(x) for x in own]
            where = np.repeat(long, out)
            both = np.zeros(len(where), np.int64)
            both[~where], both[where] = flat, np.concatenate(own)
            return both, out
        flat, many = self.propose(sym, size)
        owner = np.repeat(np.arange(len(size)), many)
        seam = np.flatnonzero(owner[:-1] == owner[1:])
        keys, back = np.unique((flat[seam] << 20) | flat[seam + 1], return_inverse=True)
        fine = self.verify(keys >> 20, keys & ((1 << 20) - 1))[back]
        failed = np.zeros(len(size), dtype=bool)
        failed[owner[seam[~fine]]] = True
        self.counts["pieces"] += len(size)
        self.counts["merged"] += int(failed.sum())
        todo = np.flatnonzero(failed)
        if not len(todo):
            return flat, many
        todo = todo[np.argsort(size[todo], kind="stable")]
        found = []
        for a in range(0, len(todo), 2048):  # of about equal length
            part = todo[a : a + 2048]
            width = int(size[part].max())
            place = np.arange(width)
            inside = place[None, :] < size[part][:, None]
            merged = self.merge_many(np.where(inside, self.unit[sym[np.where(inside, start[part][:, None] + place, 0)]], -1))
            many[part] = (merged >= 0).sum(axis=1)
            found.append((part, merged))
        out_start = np.cumsum(many) - many
        out = np.zeros(int(many.sum()), np.int64)
        out[~np.repeat(failed, many)] = flat[~failed[owner]]
        for part, merged in found:
            inside = merged >= 0
            out[(out_start[part][:, None] + np.arange(merged.shape[1]))[inside]] = merged[inside]
        return out, many

    # -- runs and texts -----------------------------------------------------------------------------------------------------

    def encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs in a row, and how many each run has; past the cache."""
        joined = "\n".join(runs)
        if self.special_re is None or not self.special_re.search(joined):
            return self._encode_plain(joined, runs)
        parts, of, special = [], [], []
        for i, r in enumerate(runs):
            for k, part in enumerate(self.special_re.split(r)):  # every second part is a special token
                if part:
                    parts.append(part)
                    of.append(i)
                    special.append(k % 2 == 1)
        own = np.array(special)
        between = [p for p, x in zip(parts, special, strict=True) if not x]
        flat, some = self._encode_plain("\n".join(between), between)
        many = np.ones(len(parts), np.int64)
        many[~own] = some
        where = np.repeat(own, many)
        out = np.zeros(len(where), np.int32)
        out[~where], out[where] = flat, [self.special[p] for p, x in zip(parts, special, strict=True) if x]
        return out, np.bincount(of, weights=many, minlength=len(runs)).astype(np.int64)

    def _encode_plain(self, joined: str, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not runs:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw = self._pieces(joined, runs)
        sym = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        stop = np.cumsum(size)
        ends_run = sym[stop - 1] == 10  # a run has no white space, so the joining newlines are pieces of their own
        sym[stop[~ends_run] - 1] += 256
        keep = np.repeat(~ends_run, size)
        flat, many = self.encode_symbols(sym[keep], size[~ends_run])
        run_of = np.cumsum(ends_run)[~ends_run]
        return self.ids[flat], np.bincount(run_of, weights=many, minlength=len(runs)).astype(np.int64)

    def _encode_runs(self, runs: list[str]) -> list[tuple[int, str, str]]:
        return self._told(*self.encode_runs(runs))

    def _told(self, flat: np.ndarray, many: np.ndarray) -> list[tuple[int, str, str]]:
        stop = np.cumsum(many).tolist()
        ids = [flat[a:b].tolist() for a, b in zip([0, *stop], stop, strict=False)]
        return [(len(x), " ".join(map(str, x)), self.decode(x)) for x in ids]

    def _pieces(self, joined: str, runs: list[str]) -> list[bytes]:
        """The bytes of all pieces of the runs, a newline between runs."""
        if joined.isascii():
            return PIECES_ASCII.findall(joined.lower().encode())
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        odd = np.flatnonzero(odd_places(points))
        out, done = [], 0
        for i in np.unique(np.searchsorted(np.flatnonzero(points == 10), odd)).tolist():  # the runs that have an odd one
            if i > done:
                out += [*self._common_pieces("\n".join(runs[done:i])), b"\n"]
            out += self._library_pieces(runs[i])
            done = i + 1
            if done < len(runs):
                out.append(b"\n")
        return out + self._common_pieces(joined if not done else "\n".join(runs[done:]))

    @staticmethod
    def _common_pieces(joined: str) -> list[bytes]:
        return [p.encode("utf-8", "surrogatepass") for p in PIECES.findall(unicodedata.normalize("NFC", joined).replace("Σ", "σ").lower())]

    def _library_pieces(self, run: str) -> list[bytes]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run))
        return [bytes(self.byte_of[c] for c in p) for p, _ in found]

    def _places(self, runs: list[str]) -> np.ndarray:
        """Where among self.rows each run's ids are, until the next call; new runs are encoded."""
        for r in self.long:
            del self.runs[r]
        self.rows.cut(len(self.rows) - len(self.long))
        self.long = []
        at = self._known(runs)
        missing = np.flatnonzero(at < 0)
        new = dict.fromkeys([runs[i] for i in missing.tolist()])
        if (len(self.runs) + len(new) > CACHED_RUNS or self.chars > CACHED_CHARS) and self.runs:
            self.older, self.older_rows, self.runs, self.rows, self.chars = self.runs, self.rows, {}, Rows(), 0
            missing, new = np.arange(len(runs)), dict.fromkeys(runs)
        kept = [r for r in new if r in self.older]
        self._add(kept, *self.older_rows.take(np.fromiter(map(self.older.get, kept), np.int64, len(kept))))
        plain, other = [], []
        for r in new:
            if r not in self.runs:
                (self.long if len(r) > LONG_RUN else plain if r.isascii() else other).append(r)
        for some in (plain, other, self.long):  # long ones last: they go first
            self._add(some, *self.encode_runs(some))
        at[missing] = self._known([runs[i] for i in missing.tolist()])
        return at

    def _known(self, runs: list[str]) -> np.ndarray:
        return np.fromiter(map(self.runs.get, runs, repeat(-1)), np.int64, len(runs))

    def _add(self, runs: list[str], flat: np.ndarray, many: np.ndarray) -> None:
        self.runs.update(zip(runs, range(len(self.rows), len(self.rows) + len(runs)), strict=True))
        self.rows.add(flat, many)
        if runs is not self.long:
            self.chars += sum(map(len, runs)) + 4 * len(flat)

    def encode(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs in a row, and how many each run has."""
        at = self._places(runs)  # first: it may start other rows
        return self.rows.take(at)

    def counts_of(self, runs: list[str]) -> np.ndarray:
        at = self._places(runs)
        return self.rows.many(at)

    def ready(self, runs: list[list[str]]) -> dict[str, tuple[int, str, str]]:
        """A dictionary of all these runs: number of tokens, ids and contents joined by a space."""
        want = list(set().union(*runs))
        return dict(zip(want, self._told(*self.encode(want)), strict=True))

    def decode(self, ids: list[int]) -> str:
        """The contents joined by a space, special tokens too: what a vocabulary file without a decoder means."""
        return " ".join(map(self.content.__getitem__, ids))


def runs_of(text: str) -> list[str]:
    """Runs without white space.  str.split() also breaks at four control characters that the vocabulary keeps."""
    return RUNS.findall(text) if ODD_SPACE.search(text) else text.split()


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch, texts in slices(batches, 1):
        runs = [runs_of(t) for t in texts]
        flat, many = enc.encode(list(chain.from_iterable(runs)))
        ends = np.concatenate(([0], np.cumsum(many)))[np.cumsum([0, *map(len, runs)])]  # where each text's ids start, and the last one's end
        offsets = pa.array(ends, pa.int32())
        said = pc.binary_join(pa.ListArray.from_arrays(offsets, enc.digits.take(pa.array(flat))), " ")
        ids = [hashlib.sha256(x.as_buffer()).hexdigest() for x in said]
        numbers, text = flat.tolist(), []
        for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            text.append(hashlib.sha256(enc.decode(numbers[a:b]).encode("utf-8", "surrogatepass")).hexdigest())
        cols = [batch.column(0).cast(pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            cols.append(pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of each row; one pass without a shuffle.

    Null and empty texts have no tokens (hashes of the empty text).  Ids may be null or repeated.  Other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return small_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(lambda it: encode_batches(it, path, keep_ids), schema)


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        out = [enc.decode(x) if x is not None else None for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of its ids; a null list gives null and an empty one the empty text.

    Ids of rows may be null or repeated, a row each; an empty table gives no rows; a list with null or with a number that no token has fails the job.
    Other columns are not read.
    """
    return encoded.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{ids_col}` as ids").mapInArrow(lambda it: decode_batches(it, path), "doc_id long, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path())
