"""Documents to overlapping chunks that never span sections.

A document's sections are in one row, so a document is chunked by one task and nothing is shuffled.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.config import ChunkConfig
from quernstone.functions import text as T

from .arrow import attach

#: What parts paragraphs and what ends a sentence.
BLANK_LINE = re.compile(r"\n\s*\n")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def hard_split(text: Column, limit: int) -> Column:
    """Consecutive windows of `limit` code points; an empty array for an empty text."""
    n = F.ceil(F.length(text) / limit).cast("int")
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(text, i * limit + 1, F.lit(limit)))
    return F.when(n > 0, windows).otherwise(F.array().cast("array<string>"))


class Part(NamedTuple):
    """A stretch of text that fits a piece.  Neighbours with the same run may share one, with a space between; None: it stands alone."""

    text: str
    run: int | None


def parts(text: str, limit: int) -> Iterator[Part]:
    """A text's paragraphs; of those that don't fit, the sentences, as one run; of sentences that don't, windows."""
    runs = itertools.count()
    for paragraph in (p.strip() for p in BLANK_LINE.split(text)):
        run, sentences = next(runs), SENTENCE_END.split(paragraph) if len(paragraph) > limit else ()
        if paragraph and not sentences:
            yield Part(paragraph, None)
        for s in sentences:
            if len(s) > limit:
                run = next(runs)  # what comes before it and after it don't meet
                yield from (Part(s[a : a + limit], None) for a in range(0, len(s), limit))
            elif s:
                yield Part(s, run)


def packed(found: Iterable[Part], glue: str, room: int) -> Iterator[str]:
    """Neighbours of one run joined by glue for as long as they fit into room."""
    held: list[str] = []
    size, run = 0, None
    for text, own in found:
        if held and own is not None and own == run and size + len(glue) + len(text) <= room:
            size += len(glue) + len(text)
        else:
            if held:
                yield glue.join(held)
            held, size = [], len(text)
        held.append(text)
        run = own
    if held:
        yield glue.join(held)


def section_pieces(text: str, limit: int) -> list[str]:
    """A section's pieces of at most `limit` characters: the whole, or its packed parts, of which small neighbours share a piece with a newline between."""
    text = text.strip()
    if len(text) <= limit:
        return [text]
    return list(packed((Part(p, 0) for p in packed(parts(text, limit), " ", limit)), "\n", limit))


def bodies(parts: Column, config: ChunkConfig) -> Column:
    """Chunks (label, text) from a document's pieces in order, array<struct<label, piece, first, alone>> (first, alone: of its section).

    A body is the end of the piece before it in its section, a newline and the piece.  It is left out where it is under min_chars, its section has
    other pieces and it is not the document's first.  With no overlap there is no such end.
    """
    before = lambda i: F.get(parts, i - 1)["piece"]
    size = config.overlap_chars
    tail = lambda p, i: F.when(p["first"] | F.lit(size == 0), F.lit("")).otherwise(F.substring(before(i), F.greatest(F.length(before(i)) - size + 1, F.lit(1)), F.lit(size)))
    body = lambda p, i: F.when(tail(p, i) == "", p["piece"]).otherwise(T.strip(F.concat(tail(p, i), F.lit("\n"), p["piece"])))
    made = F.transform(parts, lambda p, i: F.struct(p["label"].alias("label"), body(p, i).alias("text"), (p["alone"] | (i == 0)).alias("stays")))
    return F.filter(made, lambda c: c["stays"] | (F.length(c["text"]) >= config.min_chars))


def chunk(documents: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """(doc_id, filename, sections array<struct<text, label, ordinal>>) to chunks; sections come in their array's order."""
    config = config or ChunkConfig()
    kind = pa.list_(pa.struct([("label", pa.string()), ("piece", pa.string()), ("first", pa.bool_()), ("alone", pa.bool_())]))

    def cut(documents: list) -> list:
        out = []
        for sections in documents:
            split = [(s["label"] or "", section_pieces(s["text"] or "", config.max_chars)) for s in sections or []]
            out.append([{"label": x, "piece": p, "first": i == 0, "alone": len(ps) == 1} for x, ps in split for i, p in enumerate(ps)])
        return [out]

    docs = documents.select("doc_id", "filename", "sections")
    docs = attach(docs, ["sections"], [("parts", "array<struct<label:string,piece:string,first:boolean,alone:boolean>>", kind)], cut)
    out = docs.select("doc_id", "filename", F.posexplode(bodies(F.col("parts"), config)).alias("ordinal", "c"))
    out = out.select("doc_id", "filename", F.col("c.label").alias("section_label"), "ordinal", F.col("c.text").alias("text"))
    key = T.content_id(F.col("doc_id"), F.col("section_label"), F.col("ordinal").cast("string"), F.substring("text", 1, 64))
    return out.select(key.alias("chunk_id"), "doc_id", "filename", "section_label", "ordinal", "text")
