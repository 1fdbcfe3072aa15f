"""Cases from the review of round 1 in which an operator did less than the whole job."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import bpe, common, decontaminate, entry, jaccard_join, language, pii, toxicity

# -- op9_toxicity


def test_probabilities_are_those_of_the_natural_class_mix(spark):
    """A tenth of 4,000 clean and four fifths of 400 toxic texts hold a word: 320 of 720 with it are toxic, however many are sampled."""
    rows = [(i, int(i >= 4000), f"{7 * i % 4400:04d} " + ("oddword" if i % 10 < (8 if i >= 4000 else 1) else "plain")) for i in range(4400)]
    docs = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    labels = docs.select("doc_id", "toxic")
    for per_class in (200, 10_000):
        model = toxicity.train(docs, labels, per_class)
        assert 0.35 < toxicity.predict(model, ["oddword"])[0, -1] < 0.54


def test_cut_has_the_fewest_errors():
    rng = np.random.default_rng(3)
    for _ in range(30):
        p, y, rows = rng.integers(0, 12, 40) / 12, rng.integers(0, 2, 40), rng.choice([0.5, 2.0], 40)
        errors = lambda c: (rows * ((p >= c) != y)).sum()  # noqa: B023, E731
        assert np.isclose(errors(toxicity.best_cut(p, y, rows)), min(errors(c) for c in np.append(np.unique(p), 2)))
    assert toxicity.best_cut(np.array([0.1, 0.2, 0.7]), np.array([0, 0, 1]), np.ones(3)) == toxicity.THRESHOLD
    assert 0.1 < toxicity.best_cut(np.array([0.1, 0.2, 0.3]), np.array([0, 1, 1]), np.ones(3)) <= 0.2


def test_fewer_toxic_documents_are_missed(spark):
    at = "/root/testdata/sf0.1"
    rows = entry.queries()["op9_toxicity"](spark, at).join(spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r["toxic"] and not r["rejected"] for r in rows) <= 34 and sum(r["rejected"] and not r["toxic"] for r in rows) <= 8  # 39 and 0 at a fixed cut of 0.5


# -- op6_pii


def test_long_spans_are_proposed_at_every_offset(monkeypatch):
    """A tagger that takes all but full stops for an e-mail, as far as its window shows them."""

    def decode(m, x):
        inside = (x != pii.read_classes(".")[0]) & (x != pii.PAD)
        first = inside & ~np.pad(inside, ((0, 0), (1, 0)))[:, :-1]
        return np.where(first, 1, np.where(inside, 2, 0)), np.ones(x.shape)

    monkeypatch.setattr(pii, "decode", decode)
    for size in (20, 36, 48, 56, 63, 64, 90, 300):
        texts = ["." * k + "a" * (size // 2) + "@" + "b" * (size - size // 2 - 1) + "." * 200 for k in range(64)]
        assert pii.proposals({}, texts) == [[(0, k, k + size)] for k in range(64)]
    assert pii.proposals({}, ["@" * 5000 + ".", ".7" * 40]) == [[], [(0, 2 * k + 1, 2 * k + 2) for k in range(40)]]


# -- pipeline and op10_jaccard_join


def test_one_of_each_class_without_or_with_equal_ids(spark):
    base = [f"w{k}" for k in range(80)]
    near = lambda p, k: " ".join([*(p + w for w in base[:-1]), f"end{k}"])
    rows = [(None, near("a", k)) for k in (1, 2, 3, 3)] + [(7, near("b", k)) for k in (1, 2)] + [(4, near("c", 1)), (None, near("c", 2)), (None, "alone"), (9, "single")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard_join.one_of_each(docs).collect()
    assert sorted(r["text"][0] for r in kept) == ["a", "a", "b", "c", "s"] and len({r["text"] for r in kept}) == 5
    assert [r["doc_id"] for r in kept if r["text"][0] in "bc"] in ([7, 4], [4, 7])
    assert {r["doc_id"]: r["kept"] for r in jaccard_join.classes(docs).where("doc_id in (4, 9)").collect()} == {4: 1, 9: 1}


# -- op4_decontamination


def test_items_without_id_are_searched(spark):
    item, named = "the quick brown fox jumps over the lazy dog by the river", "seven wise owls sat on a branch and sang all night"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "nothing to see here"), (3, f"{named} and {item}"), (4, "say zq."), (5, named)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, item), (9, named), (None, "zq"), (None, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert {i: r["contaminated"] for i, r in got.items()} == {1: 1, 2: 0, 3: 1, 4: 1, 5: 1}
    assert got[1]["items"] == [None] and got[1]["regions"] == f"null:7:{7 + len(item)}:0" and got[3]["items"] == [9, None] and got[3]["n_items"] == 2
    assert [r["doc_id"] for r in decontaminate.without_leaks(docs, benchmark).collect()] == [2]
    assert sorted(str(i) for p in decontaminate.parts(benchmark, 30) for i, _ in p) == ["9", "None", "None"]


# -- op3_language_id


def test_every_label_is_sampled(spark):
    rows = spark.range(11_000).selectExpr("id", "case when id < 5000 then 'common' when id < 10990 then concat('rare', id) end as label").repartition(3)
    got = {r["label"]: r["n"] for r in common.bounded_sample(rows, "label", "id", 100).groupBy("label").count().withColumnRenamed("count", "n").collect()}
    assert len(got) == 5991 and all(n == 1 for k, n in got.items() if k != "common") and 50 < got["common"] < 200


def test_languages_are_learned_in_order(spark):
    rows = spark.createDataFrame([(x, f"{x} words of {x}") for x in ("b", "a", "ü", "c")] + [("d", "123")], "lang string, text string")
    langs, proto = language.learn(rows)
    assert langs == ["a", "b", "c", "ü"] and np.allclose((proto**2).sum(1), 1) and language.learn(rows.where("false"))[0] == []


# -- op2_bpe


def test_decoded_digest_comes_from_the_ids(monkeypatch):
    enc = bpe.encoder(bpe.tokenizer_path())
    seen, decode = [], bpe.Encoder.decode
    monkeypatch.setattr(bpe.Encoder, "decode", lambda self, ids: seen.append(ids) or decode(self, ids))
    texts = ["Some words, 12 of them.", "", "x" * 500 + " é" * 3, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], names=["doc_id", "text"])
    rows = [r for b in bpe.encode_batches(iter([batch]), bpe.tokenizer_path(), True) for r in b.to_pylist()]
    assert seen == [r["ids"] for r in rows]
    assert [r["decoded_sha256"] for r in rows] == [hashlib.sha256(decode(enc, r["ids"]).encode()).hexdigest() for r in rows]


def test_many_labels_are_joined_with_salt(spark, monkeypatch):
    df = spark.range(0, 6000).selectExpr("id", "case when id < 4000 then 'common' when id < 5000 then 'second' else concat('rare', id) end as label")
    told = sorted(map(tuple, common.bounded_sample(df, "label", ["id"], 100).collect()))
    monkeypatch.setattr(common, "BROADCAST_LABELS", 0)
    assert sorted(map(tuple, common.bounded_sample(df, "label", ["id"], 100).collect())) == told
    assert sum(r[1] == "common" for r in told) < 160 and sum(r[1].startswith("rare") for r in told) == 1000


# -- very long and repetitive texts: bounded memory and time, nothing left out


def grown(f):
    """What f gives, and by how many MB it raised this process's peak memory."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = f()
    return out, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1e3


def test_repetitive_text_meets_repetitive_item():
    from quernstone.llm import decontaminate

    index = decontaminate.Index(((1, "ab" * 200), (2, "ab" * 150 + "xyz" + "ab" * 50), (3, "the quick brown fox jumps over the lazy dog again")))
    n = 1_500_000
    ((found,), mb) = grown(lambda: index.find(["ab" * (n // 2) + " the quick brown fox jumps over the lazy dog again"]))
    assert {r[0] for r in found} == {1, 2, 3} and mb < 800  # the second item's three odd letters are within its budget
    held = np.zeros(n, dtype=bool)
    for i, s, e, _ in found:
        held[s:e] |= i == 1
    assert held[1000:-1000].mean() > 0.95


def test_repetitive_texts_equal_brute_force():
    from quernstone.llm import decontaminate

    rng = random.Random(8)
    for _ in range(60):
        unit = "".join(rng.choices("abc", k=rng.randint(1, 4)))
        item = list((unit * 40)[: rng.randint(20, 60)])
        for _ in range(rng.randint(0, 3)):
            item[rng.randrange(len(item))] = "x"
        text = list((unit * 60)[: rng.randint(10, 120)])
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = "y"
        item, text = "".join(item), "".join(text)
        index = decontaminate.Index(((1, item),))
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        assert bool(index.find([text])[0]) == (min(row) <= int(index.budget[0])), (item, text)


def test_items_with_missing_symbols_at_the_ends_of_texts():
    from quernstone.llm import decontaminate

    rng = random.Random(3)
    for _ in range(150):
        item = "".join(rng.choices("abcdefgh", k=rng.randint(30, 90)))
        index = decontaminate.Index(((1, item),))
        z, budget = list(item), int(index.budget[0])
        for _ in range(rng.randint(1, budget)):
            z.pop(rng.randrange(len(z)))
        text = "".join(z)
        for whole in (text, text + " words after it", "words before it " + text):
            assert index.find([whole])[0], (item, whole)


@pytest.mark.parametrize("text", ["x." * 250_000 + "@ab.de end", "a@" + "b." * 250_000 + "de end", "x" * 250_000 + "@" + "y" * 250_000, "1 " * 100_000, "a @ " * 50_000])
def test_tagger_on_one_long_token(text):
    from quernstone.llm import pii

    m = pii.train(["mail me at a.b@c.de or 10.1.2.3 now, call +1 555 123 4567"] * 20, steps=20)
    began = time.time()
    (((base, _),), mb) = grown(lambda: pii.all_spans(m, [text]))
    assert base == pii.base_spans(text) and mb < 800 and time.time() - began < 60


@pytest.mark.parametrize("unit", ["ab", "a", "Zx9", "東京都", "<|endoftext|>"])
def test_long_texts_without_white_space(unit):
    from tokenizers import Tokenizer

    from quernstone.llm import bpe, token_count

    enc = bpe.encoder(bpe.tokenizer_path())
    text = unit * (400_000 // len(unit))
    library = Tokenizer.from_file(bpe.tokenizer_path())
    want = library.encode(text, add_special_tokens=False).ids
    got, mb = grown(lambda: enc.ready([[text]])[text])
    assert got[0] == len(want) and got[1] == " ".join(map(str, want)) and mb < 600
    assert token_count.count_tokens(enc, text)[0] == len(want)
    assert token_count.count_tokens(enc, f"some words {text} and more {text}")[0] == len(library.encode(f"some words {text} and more {text}", add_special_tokens=False).ids)


def test_run_cache_is_bounded_in_characters(monkeypatch):
    from quernstone.llm import bpe

    monkeypatch.setattr(bpe, "CACHED_CHARS", 2000)
    enc = bpe.Encoder(bpe.tokenizer_path())
    runs = [f"run{i}with{i * 7}digits" for i in range(600)]
    alone = {r: bpe.Encoder._encode_runs(enc, [r])[0] for r in runs[:50]}
    for i in range(0, 600, 20):
        have = enc.ready([[*runs[i : i + 20], "x" * 5000]])
        assert all(have[r] == alone[r] for r in runs[i : i + 20] if r in alone) and have["x" * 5000][0] > 0
        assert sum(len(r) for r in enc.runs) < 2000 + 5000 + 2000
    enc.ready([["last"]])
    assert "x" * 5000 not in enc.runs and "x" * 5000 not in enc.older


# -- op1_sharding: the bound of scheduling large sizes by their class's mean


@pytest.mark.parametrize("seed", range(4))
def test_large_sizes_are_balanced_within_the_bound_of_their_steps(seed):
    """A size of a step differs from the step's mean by under 1/256 of it, so a shard's real load is within 1/256 of the one that the heap sees, and the heap's loads differ by one job at most."""
    from quernstone.llm import shard

    rng = random.Random(seed)
    sizes = [int(65_536 * 2 ** rng.uniform(0, 6)) for _ in range(30_000)]
    step = lambda s: s >> (s.bit_length() - shard.STEP_BITS) << (s.bit_length() - shard.STEP_BITS)
    members = {}
    for s in sizes:
        members.setdefault(step(s), []).append(s)
    assert all(s - c <= s / 256 for c, ss in members.items() for s in ss)
    mean = {c: -(-sum(ss) // len(ss)) for c, ss in members.items()}
    placed = shard.lpt([(f"c:{c}", mean[c], len(ss)) for c, ss in members.items()], 16)
    seen, real = [0] * 16, [0] * 16
    for c, ss in members.items():
        rng.shuffle(ss)
        at = 0
        for k, n in enumerate(placed[f"c:{c}"]):
            seen[k] += n * mean[c]
            real[k] += sum(ss[at : at + n])
            at += n
    assert max(seen) - min(seen) <= max(mean.values()) and all(abs(r - s) <= s / 256 for r, s in zip(real, seen, strict=True))
    assert max(real) / (sum(real) / 16) - 1 < 1 / 256


def test_every_window_of_a_text_can_be_trained_on(spark):
    text = "".join(chr(0x4E00 + i) for i in range(5000))
    for n in (0, 1, 127, 128, 129, 899, 900, 1027, 1028, 1029, 1929, 5000):
        cut = pii.stretches(text[:n])
        wide = 2 * pii.WINDOW
        assert all(len(c) <= pii.STRETCH + wide for c in cut) and all(any(text[a : min(a + wide, n)] in c for c in cut) for a in range(max(1, n - wide + 1)))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["mail a.b@c.de", None, "", "no such thing " * 400, "call +1 555 123 4567 " * 200] * 2)], "doc_id long, text string")
    one, two = pii.learn(rows), pii.learn(rows.repartition(5))
    assert all((one[k] == two[k]).all() for k in one)
