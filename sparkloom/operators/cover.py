"""Cover density: texts that hold all terms of a query score by how close together they hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .postings import holding

WEIGHT = 0.1  # fixed value: what a cover without other words in it counts


def covers(places: Column, n_terms: Column) -> Column:
    """Array of (first, last, noise): the minimal spans that hold all terms, in order. places: array of (pos, term), by pos,
    term from 1 to n_terms. noise is the number of words between the ends that are none of the terms.

    A sweep that keeps the latest place of each term: the span from the oldest of them to where the sweep stands is minimal
    if it begins behind the span found before."""
    start = F.struct(
        F.array_repeat(F.lit(-1), n_terms).alias("latest"),
        F.lit(-1).alias("begun"),
        F.array().cast("array<struct<first: int, last: int, noise: int>>").alias("out"),
    )

    def step(acc: Column, i: Column) -> Column:
        here = F.get(places, i)
        latest = F.transform(acc["latest"], lambda x, t: F.when(t + 1 == here["term"], i).otherwise(x))

        def closed(moved: Column) -> Column:
            oldest = F.array_min(moved)
            first = F.get(places, oldest)["pos"]
            span = F.struct(first.alias("first"), here["pos"].alias("last"), (here["pos"] - first - (i - oldest)).cast("int").alias("noise"))
            found = oldest > acc["begun"]
            return F.struct(moved.alias("latest"), F.when(found, oldest).otherwise(acc["begun"]).alias("begun"), F.when(found, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.transform(F.array(latest), closed)[0]

    steps = F.when(F.size(places) > 0, F.sequence(F.lit(0), F.size(places) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def density(spans: Column) -> Column:
    """Sum over the covers of WEIGHT / (1 + noise)."""
    return F.aggregate(spans, F.lit(0.0), lambda a, s: a + WEIGHT / (1 + s["noise"]))


def cover_density(queries: DataFrame, docs: DataFrame, least: int = 4) -> DataFrame:
    """(query_id, doc_id, score, covers) for each pair where the document holds all terms of the query: the distinct folded
    words of at least `least` characters. queries(query_id, terms or text), docs(doc_id, text).

    Which documents hold all terms of a query, and where, is found in the tasks that scan them (postings.holding). A query
    without terms, or with a term that no document holds, has no rows; null texts hold nothing."""
    terms = F.col("terms") if "terms" in queries.columns else F.array_distinct(text.folded_words("text", least))
    found = holding(queries.select("query_id", terms.alias("terms")), docs.select("doc_id", "text"), 1, places=True).withColumn("spans", covers(F.col("places"), F.col("n")))
    return found.select("query_id", "doc_id", density(F.col("spans")).alias("score"), F.size("spans").alias("covers"))
