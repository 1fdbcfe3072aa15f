"""Rerankers: each takes candidates (query_id, question, id, text, score, method, rank) and gives the best of each question."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T

from .arrow import attach
from .embed import once

#: The weights of coverage, of neighbouring pairs and of the incoming rank.
COVERAGE, PHRASE, PRIOR = 0.6, 0.3, 0.1


class NoReranker:
    name = "none"

    def rerank(self, candidates: DataFrame, limit: Column | int) -> DataFrame:
        return candidates.where(F.col("rank") <= limit)


def overlap_score(candidates: DataFrame, question: str = "question", text: str = "text", rank: str = "rank") -> DataFrame:
    """candidates with `asked` (the question's content terms) and `overlap`: 0 without a common content term, else coverage, phrase and rank together.

    What an expression uses more than once is a column before, so it is computed once a row.
    """
    rows = candidates.withColumns({"asked": T.content_terms(F.col(question)), "pairs": T.bigrams(F.col(question)), "low": F.lower(text), "has": T.content_terms(F.col(text))})
    rows = rows.withColumns({"common": F.size(F.array_intersect("asked", "has")), "near": F.size(F.filter("pairs", lambda p: F.contains(F.col("low"), p)))})
    phrase = F.when(F.size("pairs") > 0, F.col("near") / F.size("pairs")).otherwise(0.0)
    score = F.when(F.col("common") > 0, COVERAGE * F.col("common") / F.size("asked") + PHRASE * phrase + PRIOR / F.col(rank)).otherwise(0.0)
    return rows.withColumn("overlap", F.round(score, 12)).drop("pairs", "low", "has", "common", "near")


class OverlapReranker:
    """Ties keep the incoming order.  A question without content terms keeps its candidates, scores and methods."""

    name = "lexical-overlap"

    def rerank(self, candidates: DataFrame, limit: Column | int) -> DataFrame:
        has = F.size("asked") > 0
        order = Window.partitionBy("query_id").orderBy(F.when(has, -F.col("new")).otherwise(0.0), "rank")
        out = overlap_score(candidates).withColumn("new", F.when(has, F.col("overlap")).otherwise(F.col("score")))
        out = out.withColumn("to", F.row_number().over(order)).where(F.col("to") <= limit)
        return out.withColumn("method", F.when(has, "reranked").otherwise(F.col("method"))).withColumns({"score": F.col("new"), "rank": F.col("to")}).drop("new", "to", "asked", "overlap")


class CrossEncoderReranker:
    """Scores of a model that each Python worker loads once."""

    name = "cross-encoder"

    def __init__(self, model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2", load: Callable | None = None):
        if load is None:
            try:
                from sentence_transformers import CrossEncoder
            except ImportError as e:
                raise RuntimeError("the sentence-transformers package is not installed; give a loader") from e
            load = functools.partial(CrossEncoder, model)
        self.load = load

    def rerank(self, candidates: DataFrame, limit: Column | int) -> DataFrame:
        load = self.load
        compute = lambda qs, ts: [[float(x) for x in once(load).predict(list(zip(qs, ts, strict=True)))]]
        out = attach(candidates, ["question", "text"], [("new", "double", pa.float64())], compute)
        order = Window.partitionBy("query_id").orderBy(F.col("new").desc(), "rank")
        out = out.withColumn("to", F.row_number().over(order)).where(F.col("to") <= limit)
        return out.withColumns({"score": F.col("new"), "rank": F.col("to"), "method": F.lit("reranked")}).drop("new", "to")


def build_reranker(name: str = "lexical-overlap", **kw):
    kinds = {"none": NoReranker, "noop": NoReranker, "lexical-overlap": OverlapReranker, "cross-encoder": CrossEncoderReranker}
    if name not in kinds:
        raise ValueError(f"no reranker named {name!r}")
    return kinds[name](**kw)
