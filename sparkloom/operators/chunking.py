"""Cutting documents into chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ": ", ", ", " ")


def windows(c: Column | str, size: int = 800, overlap: int = 200) -> Column:
    """Array of (i, chunk): character windows with overlap. One array per row, no shuffle."""
    c = F.col(c) if isinstance(c, str) else c
    starts = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substring(c, s, F.lit(size)))


def pieces_of(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters, cut before the coarsest separator that occurs; a piece without any stays whole."""
    if len(text) <= size:
        return [text]
    for n, separator in enumerate(separators):
        if separator in text:
            out = []
            for part in re.split(f"(?={re.escape(separator)})", text):
                if part:
                    out.extend(pieces_of(part, size, separators[n + 1 :]))
            return out
    return [text]


def recursive_chunks(text: str | None, size: int = 800, overlap: int = 200) -> list[str]:
    """Neighbouring pieces joined up to size; each chunk starts with whole pieces of the one before, up to overlap."""
    out, held, length = [], [], 0
    for piece in pieces_of(text or "", size):
        if held and length + len(piece) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    if length:
        out.append("".join(held))
    return out


def chunk_documents(docs: DataFrame, size: int = 800, overlap: int = 200) -> DataFrame:
    """docs(doc_id, text) to (doc_id, i, chunk). Joining pieces runs on within one text, so it is a batch function over
    partitions; nothing is shuffled. A null or empty text has no chunks."""

    def work(batches):
        for batch in batches:
            rows = [(d, i, c) for d, t in zip(batch.doc_id, batch.text, strict=True) for i, c in enumerate(recursive_chunks(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "i", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(work, "doc_id long, i int, chunk string")


def merge_headings(parts: Column, size: int) -> Column:
    """Array of chunks: one that is only a heading joins its successor, if that is at most 1.6 times size; the joined
    chunk is not looked at again."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        joined = F.struct(F.array_append(acc["out"], F.concat(acc["open"], F.lit("\n"), x)).alias("out"), F.lit(None).cast("string").alias("open"))
        out = F.when(acc["open"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["open"]))
        heading = x.rlike(r"^#+ [^\n]*$")
        opened = F.struct(out.alias("out"), x.alias("open"))
        closed = F.struct(F.array_append(out, x).alias("out"), F.lit(None).cast("string").alias("open"))
        return F.when(acc["open"].isNotNull() & (F.length(x) <= int(1.6 * size)), joined).when(heading, opened).otherwise(closed)

    folded = F.aggregate(parts, start, step)
    return F.when(folded["open"].isNull(), folded["out"]).otherwise(F.array_append(folded["out"], folded["open"]))
