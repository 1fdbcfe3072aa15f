"""Quality scores by a regularised quadratic discriminant.

Twelve statistics of a text are transformed towards normal shape.  Each class has a mean and a covariance that is shrunk to a mix of the
pooled covariance and a sphere.  A score is the difference of the two classes' log densities, each a Mahalanobis distance by the
covariance's Cholesky factor, which is factored once; it becomes a probability by a temperature fitted on the training rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, codes, crc_mod, one_text, slices, small_batches, table

PER_CLASS = 4000
SHRINK_POOLED = 0.10
SHRINK_SPHERE = 0.02
CLIP = 8.0
THRESHOLD = 0.3
STATS = ("log_chars", "word_length", "letters", "upper", "digits", "marks", "rare_marks", "lines", "repeat", "distinct", "top_word", "mark_runs")

_kind: dict[str, np.ndarray] = {}


def kinds() -> np.ndarray:
    """Bits of each code point: 1 letter, 2 upper case, 4 digit, 8 mark (neither letter, digit nor space), 16 rare mark, 32 space."""
    if "kinds" not in _kind:
        out = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                out[c] = 1 | (2 if ch.isupper() else 0)
            elif ch.isdigit():
                out[c] = 4
            elif ch.isspace():
                out[c] = 32
            else:
                out[c] = 8 | (0 if ch in ".,;:'\"-()?" else 16)
        _kind["kinds"] = out
    return _kind["kinds"]


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics (STATS) for each text; an empty text has zeros in place of shares."""
    points, starts = codes(texts)
    kind = kinds()[points]
    size = np.maximum(np.diff(starts) - 1, 0).astype(np.float64)  # without the newline added to each text
    share = lambda bits: np.add.reduceat((bits != 0).astype(np.int64), starts[:-1])
    letters, upper, digits, marks, rare = (share(kind & b) for b in (1, 2, 4, 8, 16))
    lines = share(points == 10) - 1
    same = np.concatenate(([False], (points[1:] == points[:-1]) & (kind[1:] & 8 != 0)))
    runs = share(same)
    words = np.zeros((len(texts), 4))
    for i, t in enumerate(texts):
        w = t.split()
        if w:
            seen = Counter(w)
            words[i] = len(w), sum(map(eq, w, w[1:])), len(seen), max(seen.values())
    n = np.maximum(size, 1)
    nw = np.maximum(words[:, 0], 1)
    root = lambda x: np.sqrt(x / n)
    return np.column_stack([
        np.log1p(size), np.log1p((size - words[:, 0]).clip(0) / nw), np.arcsin(np.sqrt(np.minimum(letters / n, 1))), np.sqrt(upper / np.maximum(letters, 1)),
        root(digits), root(marks), root(rare), root(np.maximum(lines, 0)),
        np.sqrt(words[:, 1] / nw), np.log((words[:, 2] + 0.5) / (nw**0.9 + 0.5)), np.log((words[:, 3] + 0.5) / (nw + 1)), root(runs),
    ])


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Centre, scale, and for each class: mean, inverse Cholesky factor and the constant of its log density."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - centre) / scale, -CLIP, CLIP)
    p = z.shape[1]
    groups = [z[y == c] for c in (0, 1)]
    means = [g.mean(axis=0) for g in groups]
    spread = [((g - m).T @ (g - m)) / max(len(g) - 1, 1) for g, m in zip(groups, means, strict=True)]
    pooled = sum(s * len(g) for s, g in zip(spread, groups, strict=True)) / max(len(z), 1)
    model = {"centre": centre, "scale": scale, "classes": []}
    for s, m in zip(spread, means, strict=True):
        s = (1 - SHRINK_POOLED) * s + SHRINK_POOLED * pooled
        s = (1 - SHRINK_SPHERE) * s + SHRINK_SPHERE * max(np.trace(pooled) / p, 1e-6) * np.eye(p)
        low = np.linalg.cholesky(s)
        model["classes"].append({"mean": m, "whiten": np.linalg.inv(low).T, "const": -np.log(np.diag(low)).sum()})
    d = margin(model, x)
    best = min(np.geomspace(0.5, 64, 40), key=lambda t: np.logaddexp(0, np.where(y == 1, -d, d) / t).mean())
    return model | {"temperature": float(best)}


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    """Log density of class 1 less that of class 0."""
    z = np.clip((x - model["centre"]) / model["scale"], -CLIP, CLIP)
    d = [c["const"] - 0.5 * (((z - c["mean"]) @ c["whiten"]) ** 2).sum(axis=1) for c in model["classes"]]
    return d[1] - d[0]


def scores(model: dict | None, texts: list[str]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    return 1 / (1 + np.exp(-np.clip(margin(model, statistics(texts)) / model["temperature"], -30, 30)))


def stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(statistics(texts).tolist(), pa.list_(pa.float64()))], names=["quality", "stats"])


def learn(labelled: DataFrame) -> dict | None:
    """A model from rows (quality, text), which must be a bounded sample; None unless both classes have at least two rows."""
    rows = small_batches(labelled).mapInArrow(stat_batches, "quality int, stats array<double>").orderBy("quality", "stats").collect()
    y = np.array([r["quality"] for r in rows], dtype=np.int64)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    return fit(np.array([r["stats"] for r in rows]), y)


def score_batches(batches: Iterator[pa.RecordBatch], model: dict | None) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, 2):
        s = scores(model, texts)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of each document.

    Trains on about `per_class` labelled ids of each class whose crc32(doc_id) mod 5 is not 0; of rows that share an id one text is
    learned from, and equal labels of an id count once.  Null texts are scored as empty.
    Where a class has fewer than two labelled rows, every score is 0.5.  Only doc_id, text and quality are read.
    """
    held = crc_mod("doc_id", 5) == 0
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = bounded_sample(marked, "quality", ["doc_id"], per_class)  # its size is bounded by per_class, so it can be broadcast
    model = learn(one_text(rows.join(F.broadcast(some), "doc_id")).select("quality", "text"))
    return small_batches(rows).select("doc_id", held.alias("held_out"), "text").mapInArrow(lambda it: score_batches(it, model), "doc_id long, held_out boolean, score double, predicted int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
