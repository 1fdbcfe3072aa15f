"""Vectors of texts: hashed token and trigram counts, or an injected model."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import attach

TOKEN = re.compile(r"[a-z0-9']+")
#: What a token and each of its trigrams adds.
TOKEN_WEIGHT, GRAM_WEIGHT, GRAM = 1.0, 0.35, 3
BATCH = 128
#: Bounds of a worker's memory: distinct tokens whose buckets it keeps, tokens whose trigrams it lays out at once, characters of a text that is taken as a whole.
TOKENS_KEPT, TOKENS_AT_ONCE, WHOLE = 1 << 17, 1 << 15, 1 << 20


def bucket(part: str, dims: int) -> int:
    """md5 as a number modulo dims."""
    return int.from_bytes(hashlib.md5(part.encode()).digest(), "big") % dims


#: Trigrams are few (37 characters), tokens are not: those are kept by Buckets.
gram = functools.lru_cache(maxsize=1 << 16)(bucket)


class Buckets:
    """The buckets of each token seen, its own first and then those of its trigrams, in one row of numbers; starts anew beyond TOKENS_KEPT."""

    def __init__(self, dims: int):
        self.dims, self.place = dims, {}
        self.flat, self.start = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def of(self, tokens: list[str]) -> np.ndarray:
        """The places of tokens, which are learned first."""
        new = [t for t in set(tokens) if t not in self.place]
        if len(self.place) + len(new) > TOKENS_KEPT and self.place:
            self.__init__(self.dims)
            new = list(set(tokens))
        if new:
            found = [[bucket(t, self.dims), *(gram(t[i : i + GRAM], self.dims) for i in range(len(t) - GRAM + 1))] for t in new]
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.flat = np.concatenate((self.flat, np.array([b for bs in found for b in bs], np.int64)))
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum([len(bs) for bs in found])))
        return np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))


_buckets: dict[int, Buckets] = {}


def windows(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The tokens of texts in order, with the places of their texts, at most about TOKENS_AT_ONCE at a time."""
    rows: list[int] = []
    held: list[str] = []
    for row, text in enumerate(texts):
        low = text.lower()
        found = iter(TOKEN.findall(low)) if len(low) <= WHOLE else (m.group() for m in TOKEN.finditer(low))
        while part := list(itertools.islice(found, TOKENS_AT_ONCE - len(held))):
            held += part
            rows += [row] * len(part)
            if len(held) >= TOKENS_AT_ONCE:
                yield rows, held
                rows, held = [], []
    if held:
        yield rows, held


def hashed(texts: list[str], dims: int) -> np.ndarray:
    """A unit vector (double) for each text; all zeros without a token.  Tokens and trigrams are counted as whole numbers, so windows make no difference."""
    known, size = _buckets.setdefault(dims, Buckets(dims)), len(texts) * dims
    whole, grams = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for rows, tokens in windows(texts):
        at = known.of(tokens)
        many = known.start[at + 1] - known.start[at]
        first = np.cumsum(many) - many
        cells = np.repeat(np.array(rows, np.int64), many) * dims + known.flat[np.repeat(known.start[at] - first, many) + np.arange(many.sum())]
        own = np.bincount(cells[first], minlength=size)
        whole += own
        grams += np.bincount(cells, minlength=size) - own
    v = (TOKEN_WEIGHT * whole + GRAM_WEIGHT * grams).reshape(len(texts), dims)
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(n > 0, n, 1)


def vectors(rows: np.ndarray) -> pa.ListArray:
    """A matrix as a column of arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


class HashingEmbedder:
    name = "hashing"

    def __init__(self, dimensions: int = 384):
        if dimensions <= 0:
            raise ValueError("dimensions must be positive")
        self.dimensions = dimensions

    def embed(self, df: DataFrame, text: str = "text", out: str = "vector") -> DataFrame:
        """df with each text's vector; one pass, no shuffle."""
        dims = self.dimensions
        return attach(df, [text], [(out, "array<double>", pa.list_(pa.float64()))], lambda ts: [vectors(hashed([t or "" for t in ts], dims))])


class ModelEmbedder:
    """Vectors from a client that each Python worker builds once; texts go in batches and keep their order."""

    name = "openai"

    def __init__(self, dimensions: int = 1536, model: str = "text-embedding-3-small", client: Callable | None = None):
        if dimensions <= 0:
            raise ValueError("dimensions must be positive")
        self.dimensions, self.model, self.client = dimensions, model, client

    def embed(self, df: DataFrame, text: str = "text", out: str = "vector") -> DataFrame:
        dims, model, make = self.dimensions, self.model, self.client or _openai

        def compute(texts: list) -> list:
            got: list = []
            for a in range(0, len(texts), BATCH):
                reply = once(make).embeddings.create(model=model, input=[t or "" for t in texts[a : a + BATCH]], dimensions=dims)
                got += [list(map(float, r.embedding)) for r in reply.data]
            if any(len(v) != dims for v in got):
                raise ValueError(f"the model's vectors don't have {dims} numbers")
            return [got]

        return attach(df, [text], [(out, "array<double>", pa.list_(pa.float64()))], compute)


@functools.cache
def once(make: Callable):
    """What a factory makes, built once in each worker process."""
    return make()


def _openai(key: str = ""):
    try:
        from openai import OpenAI
    except ImportError as e:
        raise RuntimeError("the openai package is not installed; give a client factory") from e
    return OpenAI(api_key=key) if key else OpenAI()


def client_with(key: str) -> Callable:
    """A factory of clients that use this key; without one, the package's own way of finding it."""
    return functools.partial(_openai, key) if key else _openai


def build_embedder(name: str = "hashing", dimensions: int | None = None, client: Callable | None = None):
    if name == "hashing":
        return HashingEmbedder(dimensions or 384)
    if name == "openai":
        return ModelEmbedder(dimensions or 1536, client=client)
    raise ValueError(f"no embedder named {name!r}")
