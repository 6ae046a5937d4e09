"""Search as a table job: a table of queries in, ranked rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import vectors
from .postings import bm25_top
from .ranking import fuse, top


def search(queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", k: int = 8, threshold: float | None = None, domain: str | None = None) -> DataFrame:
    """query_id, vec_id, score, rank.

    queries(query_id, q, text); chunks(vec_id, embedding, text, domain). mode is vector, text or hybrid; hybrid fuses
    both at three times k with weights 1.5 and 1. threshold None means none. domain becomes a partition filter.
    """
    if domain is not None:
        chunks = chunks.where(F.col("domain") == domain)
    wide = k if mode != "hybrid" else 3 * k
    lists = {}
    if mode in ("vector", "hybrid"):
        lists["vector"] = (vectors.nearest(queries, chunks, wide, threshold=threshold), 1.5)
    if mode in ("text", "hybrid"):
        hits = bm25_top(queries.select("query_id", "text"), chunks.select(F.col("vec_id").alias("doc_id"), "text"), wide)
        lists["text"] = (hits.withColumnRenamed("doc_id", "vec_id"), 1.0)
    if not lists:
        raise ValueError(f"unknown mode {mode}")
    if mode != "hybrid":
        return next(iter(lists.values()))[0].select("query_id", "vec_id", "score", "rank")
    fused = fuse(lists, ["query_id"], "vec_id").withColumn("score", F.round("score", 12))
    return top(fused, ["query_id"], k, F.desc("score"), F.asc("vec_id"))


def wider(k: int) -> int:
    return min(max(k + 2, round(2.5 * k)), max(k + 2, 20))


def two_pass(queries: DataFrame, chunks: DataFrame, k: int, weak_below: float, mode: str = "vector") -> DataFrame:
    """query_id, vec_id, rank, second: a search in the given mode; queries that get no rows, fewer than min(k, 3), or whose best
    other hit is below weak_below are searched again at wider(k), always by vector and text, and both lists fused. second
    says whether a query was. queries and chunks as in search()."""
    first = written(search(queries, chunks, mode, k), "first-pass")
    best = first.groupBy("query_id").agg(F.max(F.when(F.col("vec_id") != F.col("query_id"), F.col("score"))).alias("best"), F.count("*").alias("n"))
    judged = queries.join(best, "query_id", "left").withColumn("second", (F.coalesce("n", F.lit(0)) < min(k, 3)) | (F.coalesce("best", F.lit(-1.0)) < weak_below))
    second = search(judged.where("second").select(*queries.columns), chunks, "hybrid", wider(k))
    fused = fuse({"first": (first, 1.0), "second": (second, 1.0)}, ["query_id"], "vec_id").withColumn("score", F.round("score", 12))
    ranked = top(fused, ["query_id"], k, F.desc("score"), F.asc("vec_id"))
    return ranked.join(judged.select("query_id", "second"), "query_id").select("query_id", "vec_id", "rank", "second")
