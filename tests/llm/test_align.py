"""Tokenizer alignment against loops over all pairs of tokens."""

import collections
import hashlib

import numpy as np
import pytest

from quernstone.llm import align, bpe, entry

DATA = "/root/testdata/sf0.001"
PATHS = bpe.tokenizer_path("byte_bpe_50k.json"), bpe.tokenizer_path("piece_bpe_32k.model")
FIELDS = ["doc_id", *align.LONGS, "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    alphabet = {c: b for b, c in enumerate(bpe.byte_chars())}
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])

    def ranges(text, which):
        if which == "a":
            ids = a.encode(" " + text, add_special_tokens=False).ids
            raw = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids]
        else:
            ids = b.encode(text)
            raw = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids for p in [b.id_to_piece(i)]]
        out, at = [], 0
        for i, r in zip(ids, raw, strict=True):
            out.append((i, at, at + len(r)))
            at += len(r)
        return out, b"".join(raw)

    return ranges


def brute(docs, ranges):
    """Rows as the contract words them, and the counts of all pairs."""
    linked, count = {}, collections.Counter()
    for row, (_, text) in enumerate(docs):
        linked[row] = ([], [], [])
        if not text:
            continue
        (a, joined_a), (b, joined_b) = ranges(text, "a"), ranges(text, "b")
        if joined_a != (" " + text).encode() or joined_b != joined_a:
            continue
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        linked[row] = a, b, links
        count.update(links)
    highest = collections.defaultdict(int)
    for (_, j), n in count.items():
        highest[j] = max(highest[j], n)
    rows = []
    for row, (doc_id, _) in enumerate(docs):
        a, b, links = linked[row]
        groups, since = [], 0
        for end in sorted({e for _, _, e in a} & {e for _, _, e in b}):
            groups.append(",".join(str(i) for i, s, e in a if since < e <= end) + "|" + ",".join(str(j) for j, s, e in b if since < e <= end))
            since = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), digest))
    return rows, count


ODD = [
    (1, "a plain text, that's all"), (2, None), (3, ""), (4, " "), (5, "two  spaces\n\nand\ttabs "), (6, "x▁y has the mark of the pieces"), (7, "<0x41> <s> <unk> </s> <|endoftext|>"), (8, "naïve café 東京 \U0001f600 é ͸"),
    (9, "a\x00b\x1c"), (None, "a plain text, that's all"), (1, "a plain text, that's all"), (10, "▁"), (11, "nowhitespace" * 30), (12, "日本語のテキスト。" * 9), (13, "1234567890 3.14159 'll 're 's"),
]


def order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_odd_texts(spark, libraries):
    want, count = brute(ODD, libraries)
    found = align.Alignment(spark.createDataFrame(ODD, "doc_id long, text string").repartition(3), *PATHS)
    assert order(found.documents().select(*FIELDS).collect()) == order(want)
    assert {(r["a_id"], r["b_id"]): r["n"] for r in found.pairs().collect()} == dict(count)
    kept = found.documents(keep_groups=True).collect()
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in kept)
    assert {r["doc_id"]: r["n_a"] for r in kept}[6] == 0 and {r["doc_id"]: r["n_a"] for r in kept}[7] > 0


def test_table_with_small_shards(spark, libraries, monkeypatch):
    monkeypatch.setattr(align, "SHARD_ROWS", 500)
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("length(text) < 1500").collect()]
    want, count = brute(docs, libraries)
    found = align.Alignment(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), *PATHS)
    assert order(found.documents().select(*FIELDS).collect()) == order(want)
    assert len(found.counts.files) > 5 and found.pairs().count() == len(count)


def test_partial_counts_flush(spark, monkeypatch):
    two = align.sides(*PATHS)
    import pyarrow as pa

    found = [two.encode(t) for _, t in ODD if t]
    ints = pa.list_(pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(found))), pa.array([f[0] for f in found], ints), pa.array([f[1] for f in found], ints)], names=["doc_id", "a", "b"])
    whole = collections.Counter({k: n for b in align.count_batches(iter([batch]), *PATHS) for k, n in zip(b["key"].to_pylist(), b["n"].to_pylist(), strict=True)})
    monkeypatch.setattr(align, "GATHER", 5)
    monkeypatch.setattr(align, "HELD", 7)
    monkeypatch.setattr(align, "CHARS", 10)
    pieces = collections.Counter()
    for part in align.parts(iter([batch]), 10):
        for b in align.count_batches(iter([part]), *PATHS):
            for k, n in zip(b["key"].to_pylist(), b["n"].to_pylist(), strict=True):
                pieces[k] += n
    assert whole == pieces and sum(whole.values()) > 0


def test_shards_cross_batches_and_carry_runs(tmp_path):
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(1).integers(0, 40, 300)) << 30
    n = np.arange(1, 301)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7]), pa.array(n[i : i + 7])], names=["key", "n"]) for i in range(0, 300, 7)]
    (row,) = [r for b in align.write_shard(iter(batches), str(tmp_path)) for r in b.to_pylist()]
    want = collections.Counter()
    for k, c in zip(keys.tolist(), n.tolist(), strict=True):
        want[k] += c
    assert dict(zip(np.fromfile(row["file"] + ".keys", np.int64).tolist(), np.fromfile(row["file"] + ".counts", np.int64).tolist(), strict=True)) == want
    counts = align.Counts([row], 40)
    asked = np.array(sorted(want))
    assert counts.of(asked).tolist() == [want[k] for k in asked.tolist()]
    assert all(counts.best[b] == max([c for k, c in want.items() if k >> 32 == b], default=0) for b in range(40))
    assert list(align.write_shard(iter([]), str(tmp_path))) == []


def test_empty_table_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    found = align.Alignment(none, *PATHS)
    assert found.documents().collect() == [] and found.pairs().collect() == []
    long = [(1, "word and more " * 60_000), (2, " " * 300_000 + "end"), (3, "ab" * 200_000)]
    rows = {r["doc_id"]: r for r in align.Alignment(spark.createDataFrame(long, "doc_id long, text string"), *PATHS).documents().collect()}
    assert all(rows[i]["n_links"] == rows[i]["n_a"] + rows[i]["n_b"] - rows[i]["n_groups"] > 0 for i in rows)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a text", "x", 3, None)], "doc_id long, text string, a string, key int, n_links string")
    assert align.Alignment(docs, *PATHS).documents().columns == FIELDS


def test_known_units_start_anew(monkeypatch):
    """The same ids whatever is known already, at any limit and slicing."""
    two = align.Sides(*PATHS)
    texts = [t for _, t in ODD if t] + ["a b  c\n d e \n f\tg", " lead and trail ", "x y " * 50]
    want = [(two.ids_a(" " + t), two.b.encode(t)) for t in texts]
    monkeypatch.setattr(align, "KNOWN_CHARS", 40)
    for step in (1, 3, len(texts)):
        for i in range(0, len(texts), step):
            (a, many_a), (b, many_b) = two.encode_many(texts[i : i + step])
            a, b = np.split(a, np.cumsum(many_a)[:-1]), np.split(b, np.cumsum(many_b)[:-1])
            for t, x, y, w in zip(texts[i : i + step], a, b, want[i : i + step], strict=True):
                assert (x.tolist(), y.tolist()) == (([], []) if "▁" in t else w)
    assert two.chars < 40 + sum(map(len, texts))


def test_query_covers_the_table(spark):
    rows = entry.queries()["op11_tokenizer_alignment"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())


def test_same_ids_as_the_library_on_every_character(libraries):
    two = align.sides(*PATHS)
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    texts = [form % (chr(c),) for form in ("a%s b", "1%s2 ") for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(texts), 50_000):
        assert [two.ids_a(t) for t in texts[i : i + 50_000]] == [e.ids for e in a.encode_batch(texts[i : i + 50_000], add_special_tokens=False)]
