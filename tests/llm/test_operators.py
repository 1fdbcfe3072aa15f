"""Each operator against brute force, an exact round trip or held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone import staging
from quernstone.llm import bpe, common, decontaminate, entry, jaccard_join, pii, quality, shard, token_count, topk, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


# -- sharding


def loads_of_a_heap(sizes, n):
    load = [0] * n
    for size in sorted(sizes, reverse=True):
        load[load.index(min(load))] += size
    return load


@pytest.mark.parametrize("top", [3, 40, 1000])
def test_lpt_over_sizes_equals_lpt_over_groups(top):
    rng = random.Random(top)
    sizes = [rng.randint(1, top) for _ in range(700)]
    placed = shard.lpt([(str(s), s, n) for s, n in collections.Counter(sizes).items()], 7)
    load = [sum(int(name) * got[k] for name, got in placed.items()) for k in range(7)]
    assert sum(sum(got) for got in placed.values()) == 700 and sorted(load) == sorted(loads_of_a_heap(sizes, 7))


def test_size_classes(spark):
    sizes = [1, 2, 255, 65_535, 65_536, 65_537, 70_000, 1 << 20, (1 << 20) + 4095, (1 << 40) + 12345]
    got = [r["c"] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select("s", shard.size_class(F.col("s")).alias("c")).orderBy("s").collect()]
    assert all(c == s for c, s in zip(got, sizes, strict=True) if s <= shard.EXACT) and all(0 <= s - c <= s / 256 for c, s in zip(got, sizes, strict=True))


def test_sharding(spark, texts):
    rows = entry.queries()["op1_sharding"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    load, slots, home = collections.Counter(), collections.defaultdict(list), {}
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert home.setdefault(t, r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(load) == 16
    groups = collections.Counter()
    for t in texts.values():
        groups[t] += len(t.encode()) + 1
    assert sorted(load.values()) == sorted(loads_of_a_heap(groups.values(), 16))  # what a heap over all groups gives


# -- BPE and token counts

ODD = [
    "Hello  World<|endoftext|> it's 12ab é é the\n<|startoftext|>x", "ΣΑΣ \x1c a\x1db İ ²Ⅷ x1 <|ENDOFTEXT|> <|endof text|> 日本語 ！ '''s''ll", "=" * 700 + "a" * 400 + " " + "ab" * 300, "", " \n", "́ ́a", "😀😀 ñ ñ   \xa0x\x85y",
    "don't I'LL we've 'tis THE the The", "à̖b ﻿ z‍w", "x" * 200 + " " + "<|endoftext|>" * 50, "<|startoftext|><|endoftext|>", "<|x|> <| endoftext|>",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.tokenizer_path())


def ours(enc, text):
    runs = bpe.runs_of(text)
    have = enc.ready([runs])
    return [int(x) for r in runs for x in have[r][1].split()]


def test_encoder_equals_library(enc, library, texts):
    rng = random.Random(3)
    made = ["".join(rng.choice("aábc'sdllt 12.,<|>_é\t Σß") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for t in [*ODD, *made, *texts.values()]:
        want = library.encode(t, add_special_tokens=False).ids
        assert ours(enc, t) == want, t[:80]
        assert enc.decode(want) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("context", ["{}", "a{}b", "{}\u0301x"])
def test_every_code_point_as_the_library_has_it(library, context):
    own = bpe.Encoder(bpe.tokenizer_path())
    empty = range(0x40000, 0xE0000)  # planes without a character: within a word only
    for low in range(0, 0x110000, 4096):
        if low in empty and context != "a{}b":
            continue
        text = " ".join(context.format(chr(c)) for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000)
        assert not text or ours(own, text) == library.encode(text, add_special_tokens=False).ids, hex(low)


def test_verification_agrees_with_merging(enc):
    """A proposal is kept exactly when it is what merging gives."""
    rng = random.Random(5)
    words = ["".join(rng.choice("theraionsd") for _ in range(rng.randint(2, 14))).encode() for _ in range(3000)]
    sym = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
    size = np.array([len(w) for w in words])
    sym[np.cumsum(size) - 1] += 256
    flat, many = enc.propose(sym, size)
    at, low = 0, 0
    for w, n in zip(size, many, strict=True):
        toks = flat[at : at + n]
        fine = bool(enc.verify(toks[:-1], toks[1:]).all())
        assert fine == (toks.tolist() == enc.merge_long(sym[low : low + w]).tolist())
        at, low = at + n, low + w


def test_bpe_query(spark, library, texts):
    rows = entry.queries()["op2_bpe"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def test_bpe_round_trip(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, ""), (3, None)], "doc_id long, text string")
    path = bpe.tokenizer_path()
    back = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(bpe.bpe_encode(docs, path, keep_ids=True), path).collect()}
    assert back[1].replace("</w>", "").split() == "the quick brown fox".split() and back[2] == "" and back[3] == ""


@pytest.mark.parametrize("window,overlap", [(16_384, 256), (100, 10), (37, 5)])
def test_resynchronised_counts(enc, library, texts, window, overlap):
    long = ["x" * 5000 + " " + "y z " * 3000 + "!" * 9000 + "<|endoftext|> " * 500, "a" * 70, "ab<|endoftext|>cd\t\n" * 40]
    for t in [*ODD, *long, *sorted(texts.values(), key=len)[-5:]]:
        assert token_count.count_tokens(enc, t, window, overlap)[0] == len(library.encode(t, add_special_tokens=False).ids)


def test_overlaps_are_widened(enc):
    assert token_count.count_tokens(enc, "a" * 3000 + " b", 100, 10)[1] > 0


def test_token_query(spark, library, texts):
    for r in entry.queries()["op7_token_counts"](spark, DATA).collect():
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)


# -- classifiers


def held(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_language(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = entry.queries()["op3_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (held(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in out]) > 0.98


def test_quality(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = entry.queries()["op5_quality"](spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (held(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in out]) > 0.9


def test_quadratic_discriminant_is_a_gaussian_density():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (400, 12)), rng.normal(1, 2, (400, 12))])
    y = np.repeat([0, 1], 400)
    m = quality.fit(x, y)
    z = np.clip((x - m["centre"]) / m["scale"], -quality.CLIP, quality.CLIP)
    want = []
    for c in m["classes"]:
        inverse = c["whiten"] @ c["whiten"].T
        d = z - c["mean"]
        want.append(-0.5 * np.einsum("ij,jk,ik->i", d, inverse, d) + 0.5 * np.linalg.slogdet(inverse)[1])
    assert np.allclose(quality.margin(m, x), want[1] - want[0])


def test_toxicity_held_out(spark):
    """Trained on labels whose crc32 mod 5 is not 0, scored on the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = toxicity.toxicity(docs, labels.where(~out)).join(labels.where(out).select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    assert np.mean([r["rejected"] for r in rows if r["truth"] == 1]) >= 0.9
    assert np.mean([r["rejected"] for r in rows if r["truth"] == 0]) < 0.01


def test_themes_are_clusters_of_words():
    x = np.zeros((60, 9))
    for i in range(60):
        x[i, 3 * (i % 3) : 3 * (i % 3) + 1 + i % 2 + 1] = 1
    got = toxicity.themes(x)
    assert all(len({got[i] for i in range(k, 60, 3)}) == 1 for k in range(3)) and len(set(got.tolist())) == 3
    assert toxicity.themes(np.zeros((4, 0))).tolist() == [0, 0, 0, 0]


def test_sample_is_bounded_under_repeated_keys(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(1).alias("y"))
    assert common.bounded_sample(df, "y", ["doc_id"], 4000).count() < 4400
    many = spark.range(6000).select("id", F.concat(F.lit("l"), "id").alias("y"))
    assert common.bounded_sample(many, "y", ["id"], 10).count() == 6000  # however many labels there are
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (1, "b", 0), (2, "c", 1)], "doc_id long, text string, y int")
    assert common.one_text(rows).count() == 2


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: {"spark.master": "spark://host:7077"}.get(name, default))

    with pytest.raises(staging.NoSharedFolder):
        common.shared_dir(Session())


def test_toxicity(spark):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = entry.queries()["op9_toxicity"](spark, "/root/testdata/sf0.1").collect()
    seen = [(truth[r["doc_id"]], r["rejected"]) for r in rows if r["doc_id"] in truth]
    assert np.mean([a == b for a, b in seen]) > 0.97
    assert np.mean([b for a, b in seen if not a]) < 0.01


def test_chain_feeds_out_of_fold_probabilities():
    rng = np.random.default_rng(1)
    x = (rng.random((600, 3)) < 0.5).astype(float)
    first = (x[:, 0] + rng.random(600) > 1.2).astype(int)
    y = np.column_stack([first, x[:, 1].astype(int) & first])
    models = toxicity.fit_chain(x, y, np.arange(600) % 5)
    assert [len(m) for m in models] == [4, 5]  # the second sees one probability more; each has a constant
    p = toxicity.apply_chain(models, x)
    assert ((p[:, 1] > 0.5) == y[:, 1]).mean() > 0.85 and models[1][3] > 0


# -- decontamination


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_regions_equal_brute_force():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeiostn") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 25)))) for i in range(12)] + [(90, "abc"), (91, "zq")]
    items += [(100 + n, "".join(rng.choice("bcdfghklm") for _ in range(n))) for n in range(8, 17)]  # around the least length with an edit
    index = decontaminate.Index(tuple(items))
    assert [int(index.budget[k]) for k, (_, s) in enumerate(items)] == [int(len(s) * 0.08 + 1e-9) for _, s in items]
    texts = []
    for n in range(150):
        k = n % len(items)
        budget, z = int(index.budget[k]), list(items[k][1])
        for _ in range(rng.randint(0, budget + 2)):
            at, kind = rng.randrange(len(z)), rng.randrange(3)
            if kind == 0:
                z[at] = rng.choice("xyz")
            elif kind == 1:
                z.insert(at, rng.choice("xyz"))
            elif len(z) > 1:
                z.pop(at)
        texts.append(" ".join(word() for _ in range(8)) + " " + "".join(z) + " " + " ".join(word() for _ in range(8)) + rng.choice(["", " abc.", " abcd"]))
    found = index.find(texts)
    for t, got in zip(texts, found, strict=True):
        norm = re.sub(r"[\W_]+", " ", t.lower()).strip()
        for k, (i, s) in enumerate(items):
            want = f" {s} " in f" {norm} " if len(s) < decontaminate.Q else least_edits(s, norm) <= int(index.budget[k])
            assert want == any(g[0] == i for g in got), (t, s)


@pytest.mark.parametrize("n", range(12, 18))
def test_one_substitution_in_a_short_item(n):
    item = "abcdefghijklmnopqrstuvwxyz"[:n]
    for at in range(n):
        text = "some words " + item[:at] + "9" + item[at + 1 :] + " and more"
        assert bool(decontaminate.Index(((1, item),)).find([text])[0]) == (n >= 13)


def test_a_benchmark_in_parts(spark):
    items = spark.createDataFrame([(i, f"item number {i} with its own words {i * 7919}") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before it. Item number {i}: with its own words {i * 7919}! after") for i in range(0, 60, 3)], "doc_id long, text string")
    whole = {r["doc_id"]: r["regions"] for r in decontaminate.with_regions(docs, items).collect()}
    parted = {r["doc_id"]: r["regions"] for r in decontaminate.with_regions(docs, items, part_chars=300).collect()}
    key = lambda rs: sorted(map(tuple, rs))
    assert {i: key(r) for i, r in whole.items()} == {i: key(r) for i, r in parted.items()} and all(bool(r) == (i < 40) for i, r in whole.items())


def test_decontamination_finds_whole_items(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    norm = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    want = {i: {k for k, x in items.items() if norm(x) in norm(t)} for i, t in texts.items()}
    for r in entry.queries()["op4_decontamination"](spark, DATA).collect():
        assert want[r["doc_id"]] <= set(r["items"]) and r["contaminated"] == int(bool(r["items"]))


# -- personal data


def test_base_spans_equal_patterns(texts):
    made = ["a@b.c.d@e.fg 1.2.3.4.5.6.7.8 300.1.1.1 x..@y.z @a.b q@@r.s 01.02.003.0004", "..@a.b-c.@x.y 4111 1111 1111 1111 4111-1111-1111-1112 +1 (2) 3456-789 +12 +1234567 +123456789012345678", "+1+2 345 67890 1 2 3 9" * 3]
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    n = lambda s: sum(c in "0123456789" for c in s)
    for t in [*made, *texts.values()]:
        want = [(0, m.start(), m.end()) for m in email.finditer(t)]
        want += [(1, m.start(), m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        want += [(2, m.start(), m.end()) for m in card.finditer(t) if 16 <= n(m.group()) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group()))]
        want += [(3, m.start(), m.end()) for m in phone.finditer(t) if 8 <= n(m.group()) <= 15]
        assert pii.base_spans(t) == want


def test_gradient():
    """The analytic gradient of the tagger equals finite differences."""
    m = pii.start_model(3)
    x, y = pii.training_windows(["some words here "], 3, 5)
    y = y.astype(np.int64)
    _, g = pii.step(m, x, y)
    rng = np.random.default_rng(0)
    for key in m:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in m[key].shape)
            keep = m[key][at]
            m[key][at] = keep + 1e-5
            up, _ = pii.step(m, x, y)
            m[key][at] = keep - 1e-5
            down, _ = pii.step(m, x, y)
            m[key][at] = keep
            assert abs((up - down) / 2e-5 - g[key][at]) < 1e-4


@pytest.fixture(scope="module")
def tagger(texts):
    return pii.train([s for i, t in list(texts.items())[:150] for s in pii.stretches(t)])


def test_tagger_finds_base_spans_and_adds(texts, tagger):
    some = list(texts.values())
    base = [pii.base_spans(t) for t in some]
    found = pii.proposals(tagger, some)
    hits = [s in p for b, p in zip(base, found, strict=True) for s in b]
    assert np.mean(hits) > 0.9
    made = ["call (648) 555-6701 now", "tel 648-555-6701 please", "on 2024-11-12 we had 12345 of version 3.0.1", "write to jane [at] example [dot] org today", "we met at noon. dot by dot it grew"]
    added = [a for _, a in pii.all_spans(tagger, made)]
    assert added == [[(3, 5, 19)], [(3, 4, 16)], [], [(0, 9, 36)], []]


def test_added_spans_on_generated_text(texts, tagger):
    """Precision and recall of added spans on examples that training has not seen, at every offset to a window's grid and at lengths to 120."""
    rng, cases = random.Random(99), []
    plain = [t for t in list(texts.values())[150:] if len(t) > 600 and not pii.TRIGGER.search(t)]
    for k in range(3200):
        s, kind = pii.example(rng)
        t = plain[rng.randrange(len(plain))]
        at = rng.randrange(len(t) - 400)
        before = (t[at : at + 90] + "x" * 60)[: 63 + k % 32] + " "
        cases.append((before + s + rng.choice([" ", ". ", ", ", "\n"]) + t[at + 200 : at + 300], kind, len(before), len(before) + len(s)))
    offset, size, wrong = collections.defaultdict(list), collections.defaultdict(list), 0
    for (_, kind, a, b), (base, added) in zip(cases, pii.all_spans(tagger, [c[0] for c in cases]), strict=True):
        wrong += sum(s != (kind, a, b) for s in added)
        if kind is not None and all(b <= x or a >= y for _, x, y in base):
            offset[a % 32].append((kind, a, b) in added)
            size[min((b - a) // 20, 4)].append((kind, a, b) in added)
    found = sum(map(sum, offset.values()))
    assert len(offset) == 32 and set(size) == {0, 1, 2, 3, 4}
    assert found / sum(map(len, offset.values())) >= 0.93 and found / (found + wrong) >= 0.98
    assert min(np.mean(x) for x in offset.values()) >= 0.85 and min(np.mean(x) for x in size.values()) >= 0.9


def test_windows_without_a_trigger_add_nothing(texts, tagger):
    """What a window proposes that has no digit, @, bracketed at or worded dot can't be added."""
    some = [t for t in texts.values() if not pii.TRIGGER.search(t)][:40]
    for t in some:
        where = [(0, a, min(a + pii.WINDOW, len(t))) for a in range(0, max(1, len(t)), pii.STRIDE)]
        for _, spans in pii.tagged(tagger, [t], where):
            assert not any(pii.plausible(k, t, *pii.snapped(k, t, a, b)[1:]) for k, a, b, _ in spans)


def test_reconcile_takes_the_best_set():
    assert pii.reconcile([(0, 0, 10, 3.0), (1, 5, 8, 1.0), (1, 10, 14, 1.0), (2, 0, 4, 1.0), (0, 0, 10, 3.0)]) == [(0, 0, 10), (1, 10, 14)]
    assert pii.redacted("ab cd ef", [(0, 0, 2), (1, 1, 4), (3, 6, 8)]) == "<EMAIL>d <PHONE>"


# -- top-k


@pytest.mark.parametrize("chunk", [4, 16, 1000])
def test_search_equals_brute_force(chunk):
    rng = np.random.default_rng(4)
    q, c = rng.integers(-9, 9, (13, 8)), rng.integers(-9, 9, (90, 8))
    c[10:40] = c[10]  # many ties
    c[50:] *= rng.integers(1, 30, (40, 1))
    c_id = rng.permutation(90)
    q_id = c_id[:13]
    axes = np.linalg.eigh((c.T @ c).astype(float))[1][:, ::-1]
    owner, found, score, stats = topk.search_cell(q_id, q, c_id, c, axes, 5, chunk)
    for i in range(13):
        want = sorted(((-int(q[i] @ c[j]), int(c_id[j])) for j in range(90) if c_id[j] != q_id[i]))[:5]
        assert sorted((-int(s), int(f)) for o, f, s in zip(owner, found, score, strict=True) if o == i) == want
    assert stats["exact"] <= stats["pairs"]


def test_blocks_of_queries_and_candidates(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    query = F.col("vec_id") % topk.QUERY_EVERY == 0
    one = sorted(map(tuple, topk.top_k(v, query).collect()))
    assert one == sorted(map(tuple, topk.top_k(v, query, candidates_in_block=50, queries_in_task=3, first=7, bands=6).collect()))
    x = {r["vec_id"]: [int(np.floor(256 * float(a))) for a in r["embedding"]] for r in v.collect()}
    want = []
    for i in x:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x[i], x[j], strict=True)), j) for j in x if j != i)[:5]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert one == sorted(want)


def best_by_force(x, is_query):
    out = []
    for i, v in x.items():
        if is_query(i):
            dot = lambda w, v=v: sum(a * b for a, b in zip(v, w, strict=False))
            out += [(i, k, j, -s) for k, (s, j) in enumerate(sorted((-dot(w), j) for j, w in x.items() if j != i)[:5], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4, 1000])
def test_top_k_of_odd_vectors(spark, block):
    """Empty and short vectors count as filled up; null, null components and non-finite ones take no part; lengths differ a lot."""
    rng = random.Random(block)
    x = {i: [rng.uniform(-1, 1) * 10 ** rng.randint(-2, 3) for _ in range(rng.choice([0, 1, 3, 6]))] for i in range(80)}
    x |= {80: [], 81: [1.0], 82: [-1.0], 83: [-2.0], 100: [0.5] * 6, 101: [0.5] * 6}
    odd = {200: None, 201: [None, 1.0], 202: [float("nan")], 203: [float("inf"), 1.0]}
    v = spark.createDataFrame(list((x | odd).items()), "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, topk.top_k(v, F.col("vec_id") % 3 == 0, candidates_in_block=block, queries_in_task=5, first=6, bands=5).collect()))
    assert got == best_by_force({i: [int(np.floor(256 * a)) for a in w] for i, w in x.items()}, lambda i: i % 3 == 0)
    few = spark.createDataFrame([(0, [1.0]), (1, []), (2, [-1.0]), (3, [-2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 0), (0, 2, 2, -65536), (0, 3, 3, -131072)]


def test_queries_skip_blocks_that_cannot_hold_their_best(spark):
    v = spark.createDataFrame([(i, [1000.0 / (1 + i), 1.0]) for i in range(400)], "vec_id long, embedding array<double>")
    plan = topk.top_k(v, F.col("vec_id") % 50 == 0, candidates_in_block=10, first=16, bands=64)
    assert sorted(map(tuple, plan.collect())) == best_by_force({i: [int(np.floor(256 * 1000.0 / (1 + i))), 256] for i in range(400)}, lambda i: i % 50 == 0)


def test_products_beyond_a_long_are_refused(spark):
    v = spark.createDataFrame([(0, [3.6e16]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(topk.ScoreOverflow):
        topk.top_k(v, F.col("vec_id") == 0)


def test_long_vectors_take_part_and_only_products_met_are_refused(spark):
    big = float(1 << 40)
    x = {0: [1.0, 1.0, 0.0], 50: [0.0, 0.5, big], 3: [big, 0.0, 0.0], 4: [0.0, big, 0.0], 5: [-big, 3.0, 1e-9], 6: [0.25, 0.25, 0.0], 7: []}
    v = spark.createDataFrame(list(x.items()), "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(v, F.col("vec_id") % 50 == 0, candidates_in_block=3, first=2).collect()))
    assert got == best_by_force({i: [int(np.floor(256 * a)) for a in w] for i, w in x.items()}, lambda i: i % 50 == 0)
    met = spark.createDataFrame([*x.items(), (100, [0.0, 0.0, big])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk.top_k(met, F.col("vec_id") % 50 == 0).collect()


def test_rows_without_an_id_are_candidates(spark):
    rows = [(0, [1.0, 0.0]), (None, [3.0, 0.0]), (1, [2.0, 0.0]), (None, [2.0, 0.0]), (2, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(v, F.coalesce(F.col("vec_id"), F.lit(0)) == 0).orderBy("rank").collect()]
    assert got == [(0, 1, None, 3 << 16), (0, 2, 1, 2 << 16), (0, 3, None, 2 << 16), (0, 4, 2, -1 << 16)]
    assert topk.top_k(v.where("false"), F.col("vec_id") == 0).collect() == [] and topk.top_k(v, F.col("vec_id") == 77).collect() == []


# -- Jaccard join


def words5(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(texts):
    first, sets = {}, {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    sets = {i: words5(t) for t, i in first.items()}
    ids, parent, links = list(sets), {i: i for i in sets}, collections.Counter()

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (find(first[t]), links[first[t]]) for i, t in texts.items()}


@pytest.mark.parametrize("block", [1024, 8])
def test_join_equals_brute_force(spark, block):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    texts, n = {}, 0
    for size, copies in ((60, 30), (200, 25), (8, 10), (3, 4), (400, 12)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                w[rng.randrange(size)] = word()
            texts[n] = " ".join(w)
            n += 1
    texts |= {n + i: " ".join(word() for _ in range(50)) for i in range(40)}
    texts |= {n + 40 + i: texts[i] for i in range(5)}
    texts |= {n + 50 + i: texts[i].upper().replace(" ", ", ") + "!" * i for i in range(8)}  # other texts with the same shingles
    texts |= {n + 60 + i: texts[n + i] + "." for i in range(3)} | {n + 70: "!!", n + 71: "!!", n + 72: "?"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs, block=block).collect()}
    assert got == brute_classes(texts)
    by_bytes = jaccard_join.classes(docs, block=1024, block_bytes=3000 * block).drop("digest")  # cells cut by the size of their sets
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in by_bytes.collect()} == got


def test_join_of_long_texts_and_hot_copies(spark, monkeypatch):
    """Long near copies in blocks of one or two sets, and a text with more copies than a task takes."""
    monkeypatch.setattr(jaccard_join, "HOT_COPIES", 7)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    texts = {i: " ".join([*base[: 100 * i], "new", *base[100 * i :]]) for i in range(8)}
    texts |= {100 + i: "one and the same text of a few words" for i in range(60)} | {200 + i: f"one and the same text of a few words {'more' * (i + 1)}" for i in range(3)}
    docs = spark.createDataFrame([*texts.items(), (None, texts[100])], "doc_id long, text string").repartition(5)
    rows = jaccard_join.classes(docs, block_bytes=50_000).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows if r["doc_id"] is not None} == brute_classes(texts)
    assert len(rows) == len(texts) + 1 and {r["n_copies"] for r in rows if r["doc_id"] is None or 100 <= r["doc_id"] < 200} == {61}
    assert sum(r["kept"] for r in rows) == len({r["class_id"] for r in rows})


def test_join_on_documents(spark, texts):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in entry.queries()["op10_jaccard_join"](spark, DATA).collect()}
    assert got == brute_classes(texts)


def test_pruning_bound():
    """The least agreements are where the posterior first reaches the tolerance."""
    from math import comb

    for k, m in enumerate(jaccard_join.least_agreements(0.8, 1e-6)):
        n = (k + 1) * jaccard_join.STEP
        cdf = lambda m, n=n: sum(comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(m + 1))
        assert cdf(m) >= 1e-6 and (m == 0 or cdf(m - 1) < 1e-6)


def test_components(spark, tmp_path):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in jaccard_join.components(spark.createDataFrame(edges, "u long, v long"), jaccard_join.Stage(spark))[0].collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: r for x, r in parent.items() if x != r}


# -- the pipeline


def test_pipeline(spark, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("rejected = 1").collect()}
    left = {i: t for i, t in texts.items() if i not in toxic}
    classes = brute_classes(left)
    left = {i: t for i, t in left.items() if classes[i][0] == i}
    items = [re.sub(r"[\W_]+", " ", r["text"].lower()).strip() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {i for i, t in left.items() if not any(x in re.sub(r"[\W_]+", " ", t.lower()) for x in items)}
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(rows) <= clean
    for i in clean - set(rows):  # what else is gone holds an item with edits
        norm = re.sub(r"[\W_]+", " ", texts[i].lower()).strip()
        assert any(len(x) >= decontaminate.Q and least_edits(x, norm) <= int(len(x) * decontaminate.EDITS + 1e-9) for x in items), i
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    same = [i for i in rows if not pii.TRIGGER.search(texts[i])]
    assert same and all(rows[i]["n_tokens"] == len(library.encode(texts[i], add_special_tokens=False).ids) for i in same)


def test_queries_and_sql():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in entry.queries()} == set(range(1, 13))
    assert set(entry.oracle_sql()) <= set(entry.queries())
