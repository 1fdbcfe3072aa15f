"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping windows, each with the offsets of what it encoded.  Two neighbouring windows are spliced
at the start of a run that follows white space inside both: the vocabulary's splitting rule never joins characters over white
space, so from there on both windows encode what the whole text would.  The splice is accepted only where both windows agree on every run
(start, end, number of tokens) from there to the last one that the left window saw whole; otherwise the left window's overlap
is widened and the pair encoded again, at worst to the end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import RUNS, SPACE, Encoder, encoder, runs_of, tokenizer_path
from .common import slices, small_batches, table

WINDOW = 16_384
OVERLAP = 256
LIMIT = 2048
GAP = re.compile(f"[{SPACE}]")


def window_spans(enc: Encoder, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each run of text[a:b], offsets in the whole text."""
    found = [(m.start(), m.end(), m.group()) for m in RUNS.finditer(text, a, b)]
    many = enc.counts_of([r for _, _, r in found]).tolist()
    return [(s, e, n) for (s, e, _), n in zip(found, many, strict=True)]


def count_tokens(enc: Encoder, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of a text and how often an overlap had to be widened."""
    n, a, total, since, widened = len(text), 0, 0, 0, 0
    left_end, wide = min(n, window + overlap), overlap
    left = window_spans(enc, text, a, left_end)
    while left_end < n:
        b = max(left_end - wide, a + 1)
        right_end = min(n, max(b + window + overlap, left_end))
        right = window_spans(enc, text, b, right_end)
        tail = [x for x in left if x[0] > b and x[1] < left_end]  # white space on both sides, within the left window
        head = [x for x in right if x[0] > b][: len(tail)]
        if tail and tail == head:
            at = tail[0][0]
            total += sum(c for s, _, c in left if since <= s < at)
            since, a, left, left_end, wide = at, b, right, right_end, overlap
        else:
            widened += 1
            wide *= 2
            gap = GAP.search(text, left_end)  # no boundary can come before the next white space
            left_end = min(n, max(left_end + wide, gap.end() + overlap if gap else n))
            left = window_spans(enc, text, a, left_end)
    return total + sum(c for s, _, c in left if s >= since), widened


def count_batches(batches: Iterator[pa.RecordBatch], path: str, window: int, overlap: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch, texts in slices(batches, 1):
        short = [runs_of(t) if len(t) <= window else [] for t in texts]
        many = enc.counts_of(list(chain.from_iterable(short)))
        n = np.diff(np.concatenate(([0], np.cumsum(many)))[np.cumsum([0, *map(len, short)])]).tolist()
        for i, t in enumerate(texts):
            if len(t) > window:
                n[i] = count_tokens(enc, t, window, overlap)[0]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, window: int = WINDOW, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; one pass without a shuffle.

    Null texts count as empty (0 bytes, 0 tokens).  Ids may be null or repeated.  Other columns are not read.
    """
    text = F.col(text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = small_batches(narrow).mapInArrow(lambda it: count_batches(it, path, window, overlap), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
