"""Operators that SQL can't express, row by row against their formulas written out plainly: loops, numpy.linalg, all tag sequences."""

import itertools
import zlib

import numpy as np
import pytest

from quernstone.llm import language, pii, quality

DATA = "/root/testdata/sf0.001"


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# -- language: trigram vectors one by one


def bundle(text):
    """The sum over all letters of the bound vectors of the symbol before, the letter and the symbol after; any run of other characters is one word bound."""
    symbols = language.symbols()
    run = [0]
    for ch in text.lower() + "\n":
        s = int(symbols[ord(ch)])
        if s or run[-1]:
            run.append(s)
    base = {x: v.astype(np.int64) for x, v in zip(set(run), language.letters(np.array(list(set(run)))), strict=True)}
    out = np.zeros(language.DIMS, np.int64)
    for a, b, c in zip(run, run[1:], run[2:]):
        if b:
            out += np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
    return out


def unit(v):
    n = np.sqrt(float((v.astype(float) ** 2).sum()))
    return v / n if n else v.astype(float)


def test_language_of_every_row(spark, docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.where("length(text) < 900").collect()] + [(10**6, None, "en"), (10**6 + 1, "12 !?", "en"), (None, "some words here", None)]
    bundles = [bundle(t or "") for _, t, _ in rows]
    sums = {}
    for (i, t, lang), v in zip(rows, bundles, strict=True):
        if lang is not None and t is not None and crc("" if i is None else i, 4) != 2 and v.any():
            sums[lang] = sums.get(lang, 0) + np.rint(unit(v) * language.SCALE)
    langs = sorted(sums)
    proto = np.array([unit(sums[x]) for x in langs])
    want = {}
    for (i, t, _), v in zip(rows, bundles, strict=True):
        cos = proto @ unit(v)
        want[i] = (crc("" if i is None else i, 4) == 2, langs[int(cos.argmax())], max(float(cos.max()), 0.0)) if v.any() else (crc(i, 4) == 2, "und", 0.0)
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    blocks = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), languages=1).collect()
    assert len(got) == len(blocks) == len(rows)
    for r in [*got, *blocks]:
        held, lang, score = want[r["doc_id"]]
        assert (r["held_out"], r["lang_pred"]) == (held, lang) and r["score"] == pytest.approx(score, abs=1e-5)


def test_letters_of_all_scripts_differ(spark):
    """Letters that share the low bits of their code points have vectors of their own, and scripts that share no letter are kept apart."""
    some = np.array([0x61, 0x05D0, 0x0950, 0x0627, 0x09A7, 0x4E00, 0x4E80, 0xAC00, 0x10400])
    v = language.letters(some).astype(np.int64)
    dots = v @ v.T
    assert set(np.unique(v).tolist()) == {-1, 1} and (np.abs(dots - np.diag(np.diag(dots))) < 200).all()
    assert (language.letters(some[:1]) == v[0]).all() and len(np.unique(language.letters(np.arange(0x4E00, 0x5E00)), axis=0)) == 0x1000
    spread = lambda base, k: " ".join("".join(chr(base + (7 * k + 3 * j + i) % 22) for i in range(5)) for j in range(6))
    rows = [(i, spread({"he": 0x05D0, "hi": 0x0915, "ar": 0x0641, "bn": 0x0995, "zh": 0x4E00}[x], i), x) for i, x in enumerate(["he", "hi", "ar", "bn", "zh"] * 12)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=2).collect()
    assert len(got) == 60 and all(r["lang_pred"] == rows[r["doc_id"]][2] for r in got)


# -- quality: log densities by numpy.linalg


def log_density(x, mean, cov):
    d = x - mean
    return -0.5 * d @ np.linalg.inv(cov) @ d - 0.5 * np.linalg.slogdet(cov)[1]


def test_quality_of_every_row(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    marked = sorted({(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] is not None and crc(r["doc_id"], 5) != 0 and r["doc_id"] in texts})
    stats = {i: quality.statistics([t])[0] for i, t in texts.items()}
    x, y = np.array([stats[i] for i, _ in marked]), np.array([q for _, q in marked])
    centre, scale = x.mean(0), x.std(0)
    scale[scale <= 1e-9] = 1.0
    z = lambda v: np.clip((v - centre) / scale, -quality.CLIP, quality.CLIP)
    groups = [z(x[y == c]) for c in (0, 1)]
    covs = [np.cov(g, rowvar=False) for g in groups]
    pooled = sum(c * len(g) for c, g in zip(covs, groups, strict=True)) / len(x)
    shrunk = [(1 - quality.SHRINK_POOLED) * c + quality.SHRINK_POOLED * pooled for c in covs]
    ball = np.trace(pooled) / x.shape[1] * np.eye(x.shape[1])
    shrunk = [(1 - quality.SHRINK_SPHERE) * c + quality.SHRINK_SPHERE * ball for c in shrunk]
    lead = lambda v: log_density(z(v), groups[1].mean(0), shrunk[1]) - log_density(z(v), groups[0].mean(0), shrunk[0])
    d = np.array([lead(v) for v in x])
    losses = [(float(np.logaddexp(0, np.where(y == 1, -d, d) / t).mean()), t) for t in np.geomspace(0.5, 64, 40)]
    temperature = min(losses)[1]
    rows = quality.quality(docs, labels).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = 1 / (1 + np.exp(-np.clip(lead(stats[r["doc_id"]]) / temperature, -30, 30)))
        assert r["score"] == pytest.approx(want, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (crc(r["doc_id"], 5) == 0)


# -- the tagger: cells one by one, all tag sequences


def plain_states(m, d, xs):
    h, n = [0.0] * pii.HIDDEN, pii.HIDDEN
    c, out = [0.0] * n, []
    s = lambda v: 1 / (1 + np.exp(-v))
    for x in xs:
        z = [m["x" + d][x][j] + sum(h[i] * m["u" + d][i][j] for i in range(n)) + m["c" + d][j] for j in range(4 * n)]
        c = [s(z[n + j]) * c[j] + s(z[j]) * np.tanh(z[3 * n + j]) for j in range(n)]
        h = [s(z[2 * n + j]) * np.tanh(c[j]) for j in range(n)]
        out.append(h)
    return np.array(out)


def test_decoding_equals_all_tag_sequences():
    rng = np.random.default_rng(4)
    m = {k: v.astype(np.float32) for k, v in pii.start_model(4).items()}
    m["t"], m["s"] = rng.normal(size=m["t"].shape).astype(np.float32), rng.normal(size=m["s"].shape).astype(np.float32)
    x = rng.integers(0, pii.CLASSES, (3, 4)).astype(np.uint8)
    tags, lead = pii.decode(m, x)
    trans = m["t"] + pii.allowed()
    for row, got, led in zip(x, tags, lead, strict=True):
        forth, back = plain_states(m, "f", row), plain_states(m, "b", row[::-1])[::-1]
        e = np.concatenate([forth, back], axis=1) @ m["o"] + m["ob"]
        total = lambda p, e=e: m["s"][p[0]] + sum(e[k, t] for k, t in enumerate(p)) + sum(trans[a, b] for a, b in itertools.pairwise(p))
        best = max(itertools.product(range(pii.TAGS), repeat=4), key=total)
        assert total(tuple(got.tolist())) == pytest.approx(total(best), abs=1e-3)
        assert led == pytest.approx([e[k, t] - e[k, 0] for k, t in enumerate(got.tolist())], abs=1e-3)


def test_states_equal_those_of_training():
    m = {k: v.astype(np.float32) for k, v in pii.start_model(7).items()}
    x = np.random.default_rng(7).integers(0, pii.CLASSES, (5, 40)).astype(np.uint8)
    for d in "fb":
        assert np.allclose(pii.lstm_states(m, d, x), pii.lstm(m, d, x)["h"], atol=1e-6)
