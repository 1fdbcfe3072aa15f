"""Toxicity by a classifier chain.

The categories stand in a fixed order.  Each has a linear (logistic) model over the presence of selected words and
word stems and over the probabilities of all categories before it.  For training, those probabilities are out-of-fold predictions, so a later model
learns from values as uncertain as it will meet; for prediction they come from the models fitted on all training rows.
The words and stems are those with the largest chi-square statistic against the last category on the training rows.

The labels have one mark, so the categories before the last are themes found in the training rows: the toxic rows are clustered by
the selected words that speak for toxicity (spherical k-means with a fixed start), and a row is of a theme if it is toxic and of that cluster.

Each class is sampled at its own rate, so training rows are weighted by the inverse of their class's rate: words, probabilities and the
cut are those of the natural class mix, whatever the size of the tables.  The cut on the last probability is the one with the fewest
misses and false alarms out of fold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, attach, bounded_sample, fresh, one_text, slices, small_batches, table

PER_CLASS = 4000
N_WORDS = 256
LEAST_ROWS = 5
STEM = 4
FOLDS = 5
RIDGE = 1.0
THRESHOLD = 0.5
WORD = re.compile(r"[^\W_]+")
THEMES = 3
CATEGORIES = (*(f"theme_{i + 1}" for i in range(THEMES)), "toxic")


def words(text: str) -> set[str]:
    """Distinct words, and the stems (first STEM letters, marked by *) of longer ones, which inflected forms share."""
    found = set(WORD.findall(text.lower()))
    return found | {w[:STEM] + "*" for w in found if len(w) > STEM}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the constant, which is not penalised) by Newton's method with a ridge penalty; `rows` are row weights."""
    rows = np.ones(len(x)) if rows is None else rows
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (rows * (y - p)) - pen * w
        h = (x * (rows * p * (1 - p))[:, None]).T @ x
        h[np.diag_indices_from(h)] += pen
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, rows: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """One weight vector for each column of y, in order; and the out-of-fold probabilities of the last column."""
    rows = np.ones(len(x)) if rows is None else rows
    models, out = [], np.zeros(len(x))
    for k in range(y.shape[1]):
        target = y[:, k].astype(float)
        models.append(logistic(x, target, rows=rows))
        out = np.zeros(len(x))
        for f in np.unique(fold):
            here = fold == f
            out[here] = apply(logistic(x[~here], target[~here], rows=rows[~here]), x[here]) if (~here).any() else np.average(target, weights=rows)
        x = np.column_stack([x, out])
    return models, out


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, rows: np.ndarray | None = None) -> list[np.ndarray]:
    """One weight vector for each column of y, in order."""
    return fit_out_of_fold(x, y, fold, rows)[0]


def best_cut(p: np.ndarray, y: np.ndarray, rows: np.ndarray) -> float:
    """The cut with the least weight of misses (p under it, y 1) and false alarms; among equals the nearest to THRESHOLD, where no row speaks for another."""
    order = np.argsort(p, kind="stable")
    p, missed, alarms = p[order], np.cumsum((rows * y)[order]), np.cumsum((rows * (1 - y))[order])
    ends = np.append(np.flatnonzero(np.diff(p)), len(p) - 1)  # the last row of each value
    low = np.concatenate([[0.0], p[ends]])  # a cut lies above low and not above high
    high = np.append(p[ends], 1.0)
    errors = np.concatenate([[0.0], missed[ends]]) + alarms[-1] - np.concatenate([[0.0], alarms[ends]])
    nearest = np.where((low < THRESHOLD) & (THRESHOLD <= high), THRESHOLD, (low + high) / 2)
    best = np.flatnonzero(errors <= errors.min() + 1e-9 * rows.sum())
    return float(min(nearest[best], key=lambda c: abs(c - THRESHOLD)))


def apply_chain(models: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    out = []
    for w in models:
        out.append(apply(w, x))
        x = np.column_stack([x, out[-1]])
    return np.column_stack(out)


def themes(x: np.ndarray, n: int = THEMES, rounds: int = 20) -> np.ndarray:
    """A cluster (0 to n - 1) for each row of x by spherical k-means; rows without a word, and all where there are no words, are of cluster 0.

    The first centre is the row nearest the mean, each further one the row farthest from the centres before it; ties go to the earlier row.
    """
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    v = x / np.where(size > 0, size, 1)
    out = np.zeros(len(x), dtype=np.int64)
    some = np.flatnonzero(size[:, 0] > 0)
    if not len(some):
        return out
    v = v[some]
    centres = [v[(v @ v.sum(axis=0)).argmax()]]
    for _ in range(n - 1):
        centres.append(v[np.max([v @ c for c in centres], axis=0).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        new = np.array([v[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(n)])
        new = new / np.maximum(np.sqrt((new * new).sum(axis=1, keepdims=True)), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    out[some] = (v @ c.T).argmax(axis=1)
    return out


def label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, text) to (doc_id, toxic, distinct words)."""
    for batch, texts in slices(batches, 2):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(words(t)) for t in texts], pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])


def learn(labelled: DataFrame, n_words: int = N_WORDS, counted: dict[int, int] | None = None) -> dict | None:
    """A chain and its cut from rows (doc_id, toxic, text), which must be a bounded sample; None unless both classes occur.

    `counted`: how many rows each class has where the sample comes from.  `held_out` counts the training rows missed and falsely
    rejected out of fold.
    """
    rows = small_batches(labelled).mapInArrow(label_batches, "doc_id long, toxic int, words array<string>")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    stands_for = {c: max(1.0, (counted or sizes).get(c, 0) / sizes[c]) for c in (0, 1)}  # rows that one row of the sample is for
    n1 = stands_for[1] * sizes[1]
    n = stands_for[0] * sizes[0] + n1
    a = F.lit(stands_for[1]) * F.col("a")
    df = F.lit(stands_for[0]) * (F.col("df") - F.col("a")) + a
    lift = a * n - df * n1
    chosen = (
        rows.select("toxic", F.explode("words").alias("word"))
        .groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("df"))
        .where((F.col("df") >= LEAST_ROWS) & (F.col("df") < sizes[0] + sizes[1]))
        .orderBy((lift * lift / (df * (n - df))).desc(), "word").limit(n_words).select("word", (lift > 0).alias("speaks")).collect()
    )
    vocab = {r["word"]: i for i, r in enumerate(chosen)}
    speaks = np.array([r["speaks"] for r in chosen], dtype=bool)
    listed = F.array(*[F.lit(w) for w in vocab]) if vocab else F.array().cast("array<string>")
    data = rows.select("doc_id", "toxic", F.array_intersect("words", listed).alias("words")).orderBy("doc_id", "toxic").collect()
    x = np.zeros((len(data), len(vocab)))
    for i, r in enumerate(data):
        x[i, [vocab[w] for w in r["words"]]] = 1
    toxic = np.array([r["toxic"] for r in data])
    theme = np.full(len(data), -1)
    theme[toxic == 1] = themes(x[toxic == 1][:, speaks])
    y = np.column_stack([*(theme == k for k in range(THEMES)), toxic]).astype(int)
    fold = np.array([(r["doc_id"] or 0) * 2_654_435_761 % (1 << 32) * FOLDS >> 32 for r in data])
    weight = np.where(toxic == 1, stands_for[1], stands_for[0])
    weight = weight / weight.mean()  # the ridge penalty is held against as many rows as were sampled
    models, out = fit_out_of_fold(x, y, fold, weight)
    cut = best_cut(out, toxic, weight)
    held_out = {"toxic": int(toxic.sum()), "missed": int(((out < cut) & (toxic == 1)).sum()), "clean": int((toxic == 0).sum()), "false_alarms": int(((out >= cut) & (toxic == 0)).sum())}
    return {"vocab": vocab, "models": models, "cut": cut, "held_out": held_out}


def predict(model: dict | None, texts: list[str]) -> np.ndarray:
    """Probabilities of CATEGORIES; all 0 without a model."""
    if model is None:
        return np.zeros((len(texts), len(CATEGORIES)))
    vocab = model["vocab"]
    known = vocab.keys()
    x = np.zeros((len(texts), len(vocab)))
    for i, t in enumerate(texts):
        x[i, [vocab[w] for w in words(t) & known]] = 1
    return apply_chain(model["models"], x)


def rejects(model: dict | None, p: np.ndarray) -> np.ndarray:
    return p[:, -1] >= (model["cut"] if model else THRESHOLD)


def score_batches(batches: Iterator[pa.RecordBatch], model: dict | None) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, 1, each=512):
        p = predict(model, texts)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in p.T), pa.array(rejects(model, p).astype(np.int32))], names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "rejected"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """The model of about `per_class` labelled ids of each class; one text an id, copies of a text once."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    some = bounded_sample(marked, "toxic", ["doc_id"], per_class)  # its size is bounded by per_class, so it can be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    found = one_text(rows.join(F.broadcast(some), "doc_id"))
    once = found.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by(F.struct("doc_id", "toxic", "text"), F.struct("doc_id", "toxic")).alias("r")).select("r.*")  # copies count once
    stage = Stage(docs.sparkSession)
    sample = stage.keep(once, "sample")  # read several times; the documents are read once
    counted = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model = learn(sample, counted=counted)
    stage.drop(sample)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, p_theme_1 to p_theme_3, p_toxic, rejected (1 where p_toxic >= the cut of the model) of each document; one pass without a shuffle.

    The chain is trained on about `per_class` labelled ids of each class, weighted back to the counted class sizes.  Null texts are scored as empty.  Without labelled rows
    of both classes all probabilities are 0.  Ids may be null or repeated.  Only doc_id, text and toxic are read.
    """
    model = train(docs, labels, per_class)
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", rejected int"
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: score_batches(it, model), schema)


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs that are not rejected, all columns as they are.

    Null and empty texts are scored as empty and stay unless an empty text is rejected; equal texts share their fate; an empty table stays empty; without labelled rows of
    both classes every row stays.  Ids may be null or repeated; other columns, whatever their names, are not read.
    """
    model = train(docs, labels, per_class)
    compute = lambda texts: [rejects(model, predict(model, texts)).tolist()]
    name = fresh(docs, "rejected")
    return attach(docs, [(name, "boolean", pa.bool_())], compute, each=512).where(~F.col(name)).drop(name)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
