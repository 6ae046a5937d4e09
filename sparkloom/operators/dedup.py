"""Removing repeats: inside a text, over a result list, over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def first_per(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the given total order. A partial aggregate per task keeps one row a key before the
    shuffle, so a key with very many rows does not gather in one task."""
    row = F.struct(*[F.col(c) for c in df.columns])
    first = df.groupBy(key.alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def unique_paragraphs(c: Column | str, breaks: str = "\n") -> Column:
    """Paragraphs of a text without those whose folded form came before; blank ones go. In the row, no shuffle. breaks is a
    pattern of ASCII white space or marks, which folding leaves where they are."""
    parts = F.zip_with(F.split(c, breaks), F.split(text.unmarked(c), breaks), lambda p, k: F.struct(p.alias("p"), text.plain(k).alias("k")))
    empty = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        known = F.array_contains(acc["seen"], x["k"]) | (x["k"] == "")
        more = F.struct(F.array_append(acc["kept"], x["p"]).alias("kept"), F.array_append(acc["seen"], x["k"]).alias("seen"))
        return F.when(known, acc).otherwise(more)

    return F.array_join(F.aggregate(parts, empty, step)["kept"], breaks)


def not_contained(items: Column, limit: int) -> Column:
    """Strings in the given order without those that a kept one contains, or that contain a kept one; at most limit."""
    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda k: F.contains(k, x) | F.contains(x, k))
        return F.when(clash | (F.size(acc) >= limit), acc).otherwise(F.array_append(acc, x))

    return F.aggregate(items, F.array().cast("array<string>"), step)
