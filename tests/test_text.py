"""Column functions against a plain restatement."""

import hashlib
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone import config
from quernstone.functions import text as T
from quernstone.operators.chunk import Part, chunk, hard_split, packed, parts, section_pieces
from quernstone.operators.embed import HashingEmbedder, build_embedder, bucket


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens_and_stems(spark):
    assert one(spark, "Reset ERR_LOCK_TIMEOUT now!", T.tokens) == ["reset", "err", "lock", "timeout", "now"]
    want = {"seats": "seat", "charged": "charg", "charges": "charg", "invoices": "invoic", "invoice": "invoice", "being": "being", "needs": "need", "running": "runn", "bring": "bring", "address": "addres"}
    got = spark.createDataFrame([(k,) for k in want], "x string").select("x", T.stem(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == want


def test_terms_pairs_sentences(spark):
    assert len(T.STOPWORDS) == 49
    assert one(spark, "How do I reset the reset key", T.content_terms) == ["reset", "key"]
    assert one(spark, "a b a b c", T.bigrams) == ["a b", "b a", "b c"] and one(spark, "a", T.bigrams) == [] and one(spark, "", T.bigrams) == []
    text = "One. Two!  Three?\nFour five. Six"
    assert one(spark, text, T.sentences) == re.split(r"(?<=[.!?])\s+", text)
    assert one(spark, "  a \t\n b c \x1c", T.collapse) == "a b c" and one(spark, "\n a\t ", T.strip) == "a"


def test_ids(spark):
    row = spark.range(1).select(T.content_id(F.lit("a"), F.lit("b")).alias("i"), T.citation(F.lit("f"), F.lit("l")).alias("c"), T.citation(F.lit("f"), F.lit("")).alias("d"), T.citation(F.lit(""), F.lit("l")).alias("e"), T.section_key(F.lit("f"), F.lit("l")).alias("k")).first()
    assert tuple(row) == ("c8687a08aa5d6ed2044328fa6a697ab8", "[f, l]", "[f]", "[l]", "f#l")


@pytest.mark.parametrize("dims", [384, 256, 1000])
def test_bucket(spark, dims):
    words = ["reset", "password", "a", "", "ñ", "the"]
    got = spark.createDataFrame([(w,) for w in words], "x string").select(T.bucket(F.col("x"), dims).alias("b")).collect()
    assert [r["b"] for r in got] == [int(hashlib.md5(w.encode()).hexdigest(), 16) % dims for w in words] == [bucket(w, dims) for w in words]
    assert bucket("reset", 384) == 297


def test_intents(spark):
    want = {"What documents are there": "inventory", "please SUMMARISE it": "summarise", "ERR_LOCK": "lookup", "the sku": "lookup", "the SKU": "answer", "": "answer", "summarised": "answer", "invoice 12": "lookup"}
    got = spark.createDataFrame([(k,) for k in want], "x string").select("x", T.intent(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == want


def test_hash_embedding(spark):
    df = spark.createDataFrame([("abc ab",), ("",), (None,)], "text string")
    v = [r["vector"] for r in HashingEmbedder(16).embed(df).collect()]
    want = [0.0] * 16
    want[bucket("abc", 16)] += 1.35
    want[bucket("ab", 16)] += 1
    n = sum(x * x for x in want) ** 0.5
    assert v[0] == pytest.approx([x / n for x in want]) and v[1] == v[2] == [0.0] * 16
    with pytest.raises(ValueError):
        HashingEmbedder(0)
    with pytest.raises(ValueError):
        build_embedder("other")
    assert build_embedder("openai").dimensions == 1536 and build_embedder().dimensions == 384


def test_hard_split(spark):
    assert one(spark, "abcdefg", lambda x: hard_split(x, 3)) == ["abc", "def", "g"]
    assert one(spark, "", lambda x: hard_split(x, 3)) == []


def plain_chunks(text, limit):
    """The merged pieces of a section by their definition."""
    if len(text) <= limit:
        return [text]
    out = []
    for p in re.split(r"\n\s*\n", text):
        p = p.strip()
        if p and len(p) <= limit:
            out.append(p)
        elif p:
            held = ""
            for s in re.split(r"(?<=[.!?])\s+", p):
                if len(s) > limit:
                    out += [held] if held else []
                    held = ""
                    out += [s[i : i + limit] for i in range(0, len(s), limit)]
                elif len(f"{held} {s}" if held else s) <= limit:
                    held = f"{held} {s}" if held else s
                else:
                    out.append(held)
                    held = s
            out += [held] if held else []
    return out or [text[:limit]]


TEXT = st.text(alphabet="ab.!? \n", max_size=120)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(TEXT, st.integers(3, 30))
def test_pieces(text, limit):
    text = text.strip()
    got = list(packed(parts(text, limit), " ", limit)) if len(text) > limit else [text]
    assert [p for p in got if p] == [p for p in plain_chunks(text, limit) if p]
    merged = []
    for p in plain_chunks(text, limit):
        if merged and len(merged[-1]) + 1 + len(p) <= limit:
            merged[-1] += "\n" + p
        else:
            merged.append(p)
    assert [p for p in section_pieces(text, limit) if p] == [p for p in merged if p]


def test_parts_of_one_run_are_packed():
    found = [Part("a", 1), Part("b", 1), Part("c", 2), Part("d", None), Part("e", None), Part("ffff", 3), Part("g", 3)]
    assert list(packed(found, " ", 5)) == ["a b", "c", "d", "e", "ffff", "g"]


@pytest.mark.parametrize("overlap", [0, 13])
def test_chunk_rule(spark, overlap):
    """Every document's chunks by the rule, document by document: what is dropped, what tails are, how ordinals run."""
    rng, limit, least = random.Random(overlap), 40, 20
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", "!"])
    docs = []
    for i in range(60):
        docs.append((str(i), f"f{i}", [(rng.choice([" ", "\n\n"]).join(word() for _ in range(rng.choice([0, 1, 5, 30]))), f"s{n}", n) for n in range(rng.randint(0, 4))]))
    rows = spark.createDataFrame(docs, "doc_id string, filename string, sections array<struct<text:string,label:string,ordinal:int>>")
    got = {}
    for r in chunk(rows, config.ChunkConfig(limit, overlap, least)).collect():
        got.setdefault(r["doc_id"], []).append((r["ordinal"], r["section_label"], r["text"]))
    for key, _, sections in docs:
        want = []
        for text, label, _ in sections:
            parts = section_pieces(text, limit)
            for n, p in enumerate(parts):
                tail = parts[n - 1][-overlap:] if n and overlap else ""
                body = (tail + "\n" + p).strip() if tail else p
                if len(body) >= least or len(parts) == 1 or not want:
                    want.append((len(want), label, body))
        assert sorted(got.get(key, [])) == want
        assert all(len(b) <= limit + overlap + 1 for *_, b in want)


def test_configs(monkeypatch):
    for bad in ((100, 100), (0, -1)):
        with pytest.raises(ValueError):
            config.ChunkConfig(*bad)
    for name, said in (("CANDIDATE_K", "x"), ("MIN_RELEVANCE", "0.3"), ("ENABLE_METRICS", "no"), ("LLM", "openai")):
        monkeypatch.setenv(name, said)
    s = config.Settings()
    assert (s.candidate_k, s.min_relevance, s.enable_metrics, s.remote_models) == (12, 0.3, False, ["llm"])
