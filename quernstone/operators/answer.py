"""Answers with citations, or refusals, for a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T

from .arrow import attach
from .embed import _openai, once

#: Fixed value: the text of a refusal.
REFUSAL = (
    "I could not find this in the indexed documents. Rather than guess, here is what is missing: no passage matched this question "
    "above the relevance threshold. Try rephrasing, or ingest the source that should contain it."
)
LEAST_SENTENCE, SENTENCES, CITED_PARTS = 20, 3, 4
#: How many passages an intent reads (None: the setting), and its handler's name.
HANDLERS = {"answer": (None, "grounded-answer"), "lookup": (2, "exact-lookup"), "summarise": (8, "summariser"), "inventory": (0, "inventory")}


def extract_answers(passages: DataFrame, sentences: int = SENTENCES) -> DataFrame:
    """(query_id, completion) from passages (query_id, question, text, rank): the sentences that share most tokens with the question.

    A sentence counts with 1 / rank of its passage on top; ties go to the earlier passage and sentence; equal sentences count once.
    Questions without such a sentence have no row.
    """
    split = passages.select("query_id", "question", "rank", F.posexplode(T.sentences(F.col("text"))).alias("pos", "raw"))
    split = split.select("query_id", "rank", "pos", T.collapse(F.col("raw")).alias("sentence"), T.tokens(F.col("question")).alias("asked"))
    common = F.size(F.array_intersect("asked", T.tokens(F.col("sentence"))))
    split = split.where(F.length("sentence") >= LEAST_SENTENCE).withColumn("common", common).where("common > 0")
    split = split.withColumn("s", F.round(F.col("common") + 1 / F.col("rank"), 12))
    first = split.groupBy("query_id", "sentence").agg(F.min(F.struct(-F.col("s"), "rank", "pos")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at")
    best = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sentences)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda x: x["sentence"]), " ")
    return best.groupBy("query_id").agg(told.alias("completion"))


class ExtractiveAnswers:
    name = "extractive"

    def complete(self, passages: DataFrame) -> DataFrame:
        return extract_answers(passages)


class ModelAnswers:
    """Completions of a chat model; the client is built once in each Python worker.  Questions without passages are not sent."""

    name = "openai"

    def __init__(self, model: str = "gpt-4o-mini", client: Callable | None = None):
        self.model, self.client = model, client

    def complete(self, passages: DataFrame) -> DataFrame:
        model, make = self.model, self.client or _openai
        listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), "citation", F.lit("]\n"), "text").alias("t")))), lambda x: x["t"])
        asked = passages.groupBy("query_id").agg(F.first("question").alias("question"), F.array_join(listed, "\n\n").alias("context"))

        def compute(questions: list, contexts: list) -> list:
            out = []
            for q, c in zip(questions, contexts, strict=True):
                told = [{"role": "system", "content": "Answer only from the context and cite it."}, {"role": "user", "content": f"Context:\n{c}\n\nQuestion: {q}"}]
                out.append(once(make).chat.completions.create(model=model, temperature=0, messages=told).choices[0].message.content or "")
            return [out]

        return attach(asked, ["question", "context"], [("completion", "string", pa.string())], compute).select("query_id", "completion")


def build_llm(name: str = "extractive", client: Callable | None = None):
    if name == "extractive":
        return ExtractiveAnswers()
    if name == "openai":
        return ModelAnswers(client=client)
    raise ValueError(f"no language model named {name!r}")


def cited(passages: DataFrame, completions: DataFrame) -> DataFrame:
    """(query_id, citations): those of the passages of which one of the first parts stands in the completion, else of the first passage."""
    both = passages.join(completions, "query_id").where(F.trim("completion") != "")
    used = F.exists(F.slice(F.split("text", r"\. "), 1, CITED_PARTS), lambda p: (p != "") & F.contains(F.col("completion"), p))
    each = both.select("query_id", F.struct("rank", "citation").alias("c"), used.alias("used"))
    listed = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.col("used"), F.col("c")))).alias("u"), F.min("c").alias("first"))
    names = F.when(F.size("u") > 0, F.array_distinct(F.transform("u", lambda x: x["citation"]))).otherwise(F.array(F.col("first.citation")))
    return listed.select("query_id", names.alias("citations"))


def answer(questions: DataFrame, passages: DataFrame, llm=None, floor: float = 0.15) -> DataFrame:
    """A row for each question (query_id, question): text, grounded, escalated, confidence, citations, passages, top (the best score).

    passages (query_id, question, id, text, citation, section_label, filename, score, method, rank) are the reranked ones.  A blank question,
    no passage, a best score under floor, or an empty completion is a refusal; a refusal keeps its passages.
    """
    llm = llm or ExtractiveAnswers()
    top = passages.groupBy("query_id").agg(
        F.max_by("score", -F.col("rank")).alias("top"),
        F.array_sort(F.collect_list(F.struct("rank", "text", "citation", "section_label", "filename", F.round("score", 4).alias("score"), "method"))).alias("passages"),
    )
    completions = llm.complete(passages)
    out = questions.join(top, "query_id", "left").join(completions, "query_id", "left").join(cited(passages, completions), "query_id", "left")
    refused = (T.strip(F.col("question")) == "") | F.col("top").isNull() | (F.col("top") < floor) | F.col("completion").isNull() | (F.trim("completion") == "")
    none = F.array().cast("array<string>")
    return out.select(
        *questions.columns,
        F.when(refused, F.lit(REFUSAL)).otherwise(F.col("completion")).alias("text"),
        (~refused).alias("grounded"),
        refused.alias("escalated"),
        F.round(F.coalesce("top", F.lit(0.0)), 4).alias("confidence"),
        F.when(refused, none).otherwise(F.col("citations")).alias("citations"),
        F.coalesce("passages", F.array().cast(out.schema["passages"].dataType)).alias("passages"),
        "top",
    )


def inventory(documents: DataFrame) -> DataFrame:
    """One row: how many documents there are and their names in order; `escalated` if there are none."""
    names = F.array_sort(F.collect_list("filename"))
    told = F.when(F.count("*") == 0, "No documents are indexed yet.").otherwise(F.concat(F.count("*").cast("string"), F.lit(" document(s) indexed: "), F.array_join(names, ", ")))
    return documents.agg(told.alias("text"), (F.count("*") == 0).alias("escalated"))
