"""The encoder's cache of runs: flat rows of ids, two generations, long runs forgotten."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import bpe, token_count

SHAPES = ["{}", "{},", "É{}é", "{}'s", "{}<|endoftext|>", "<|startoftext|>{}<|endoftext|><|endoftext|>", "{}<|x|>", "͸{}", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(["the", "on", "er", "ing", "at", "re", "st", "zq"]) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def test_cached_runs_are_small():
    """A run's ids are numbers in an array; as two strings and a tuple they took about 240 bytes beside the run itself."""
    enc = bpe.Encoder(bpe.tokenizer_path())
    runs = [f"{w}{i}" for i, w in enumerate(words(40_000, 1))]
    enc.ready([runs[:1000]])
    tracemalloc.start()
    try:
        for a in range(1000, 40_000, 1000):
            enc.ready([runs[a : a + 1000]])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(enc.runs) == 40_000 and held / 39_000 < 200


@pytest.mark.parametrize("cached", [40, 400])
def test_rows_stay_right_when_the_cache_starts_anew(monkeypatch, library, cached):
    monkeypatch.setattr(bpe, "CACHED_RUNS", cached)
    enc = bpe.Encoder(bpe.tokenizer_path())
    monkeypatch.setattr(bpe, "_loaded", {bpe.tokenizer_path(): enc})
    rng = random.Random(2)
    made = [rng.choice(SHAPES).format(w) for w in words(300, 3)] + ["long" * 400, "é" * 1500]
    texts = [" ".join(rng.choices(made, k=rng.randint(0, 60))) for _ in range(200)] + ["", None, " \n "]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(part))), pa.array(part, pa.string()), pa.array([0] * len(part), pa.int64())], names=["doc_id", "text", "n_bytes"]) for part in (texts[i : i + 7] for i in range(0, len(texts), 7))]
    rows = [r for b in bpe.encode_batches(iter(batches), bpe.tokenizer_path(), True) for r in b.to_pylist()]
    counts = [r["n_tokens"] for b in token_count.count_batches(iter(batches), bpe.tokenizer_path(), 100, 20) for r in b.to_pylist()]
    for t, r, n in zip(texts, rows, counts, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == n == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert len(enc.runs) <= cached + 7 * 60 and len(enc.rows) == len(enc.runs)


def test_room_of_long_runs_is_given_back():
    enc = bpe.Encoder(bpe.tokenizer_path())
    enc.encode(["some", "words"])
    flat, many = enc.encode(["some", "zq" * 1_000_000, "words"])
    assert many[1] == len(flat) - many[0] - many[2] > 500_000
    enc.encode(["more"])
    assert len(enc.rows.flat) < 1 << 20 and len(enc.rows) == len(enc.runs) == 3
    assert np.array_equal(enc.encode(["some", "words"])[0], np.concatenate([flat[: many[0]], flat[-many[2] :]]))
