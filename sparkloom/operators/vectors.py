"""Exact and approximate vector search over tables of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..sources.shared import written
from .blocks import CELLS, Best, in_arrow
from .ranking import ranked, top


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def _units(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have a direction (finite, not zero, `size` long), and their unit vectors."""
    places, rows = [], []
    for i, x in enumerate(column.to_pylist()):
        if x and None not in x and (size is None or len(x) == size):
            v = np.array(x, float)
            length = np.sqrt(v @ v)
            if np.isfinite(length) and length > 0:
                size = len(x)
                places.append(i)
                rows.append(v / length)
    return np.array(places, np.int64), np.array(rows).reshape(len(rows), size or 0)


def _scored(best: Best, asked: np.ndarray, batch: pa.RecordBatch, vector: str = "embedding") -> None:
    step = max(1, min(1 << 11, CELLS // max(1, len(asked))))
    for at in range(0, batch.num_rows, step):
        some = batch.slice(at, step)
        places, rows = _units(some.column(vector), asked.shape[1])
        scores = asked @ rows.T
        best.add(np.add(np.round(scores, 6, out=scores), 0.0, out=scores), some.column("vec_id").to_numpy(zero_copy_only=False)[places])


def nearest(queries: DataFrame, vectors: DataFrame, k: int | None, most_queries: int = 4096, threshold: float | None = None, within: str | None = None, block: int = 1 << 14) -> DataFrame:
    """query_id, vec_id, score, rank: the k rows with the highest cosine to each query, ties to the smaller vec_id.

    queries(query_id, q), vectors(vec_id, embedding). Vectors without a direction (null, empty, zero, not finite) and
    those of another length than the queries answer nothing. threshold None keeps all scores; k None keeps all rows that
    reach the threshold. within names a column of few values of vectors: the k best of each value, which is returned too.

    Up to most_queries queries go to the tasks that scan the vectors, and a task returns its k best rows a query. More
    meet the vectors in pairs of blocks of most_queries queries and `block` vectors, so no task holds more than that.
    """
    queries = queries.select(F.col("query_id").cast("long"), F.col("q").cast("array<double>").alias("q"))
    group = [within] if within else []
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = "query_id long, vec_id long, score double" + "".join(f", {g} {kinds[g]}" for g in group)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), *group)

    def collected(ids: np.ndarray, asked: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests: dict = {}
        for batch in batches:
            values = batch.column(within).to_pylist() if within else [None] * batch.num_rows
            for value in dict.fromkeys(values):
                best = bests.setdefault(value, Best(len(ids), k, threshold))
                _scored(best, asked, batch.filter(pa.array([v == value for v in values])) if within else batch)
        for value, best in bests.items():
            at, found, scores, _ = best.taken()
            made = [pa.array(ids[at]), pa.array(found), pa.array(scores)]
            yield pa.RecordBatch.from_arrays([*made, *(pa.array([value] * len(at), batch.schema.field(g).type) for g in group)], ["query_id", "vec_id", "score", *group])

    asked = queries.limit(most_queries + 1).toArrow()
    if asked.num_rows <= most_queries:
        places, units = _units(asked.column("q").combine_chunks())
        ids = asked.column("query_id").to_numpy()[places]
        sent = queries.sparkSession.sparkContext.broadcast((ids, units))
        found = in_arrow(rows, lambda batches: collected(*sent.value, batches), schema)
    else:
        q_blocks, v_blocks = -(-queries.count() // most_queries), max(1, -(-rows.count() // block))
        left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(v_blocks - 1).cast("long"))))
        right = rows.withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.lit(v_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            places, units = _units(left.column("q").combine_chunks())
            parts = list(collected(left.column("query_id").to_numpy()[places], units, iter(right.combine_chunks().to_batches())))
            return pa.Table.from_batches(parts) if parts else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), **{g: pa.array([], right.schema.field(g).type) for g in group}})

        found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(pair, schema)
    order = (F.desc("score"), F.asc("vec_id"))
    return ranked(found, ["query_id", *group], *order) if k is None else top(found, ["query_id", *group], k, *order)


def listed(df: DataFrame, vector: str, centers: np.ndarray, many: int) -> DataFrame:
    """df with `lists`, the `many` lists whose centers have the largest inner product with the vector, best first. A
    vector that is null or of another length counts as zero."""
    size = centers.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x if x is not None and len(x) == size and None not in x else [0.0] * size for x in batch.column(vector).to_pylist()]
            scores = np.array(rows, float).reshape(-1, size) @ centers.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, :many]
            lists = pa.array(best.astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "lists"])

    return df.mapInArrow(work, StructType([*df.schema.fields, StructField("lists", ArrayType(IntegerType()))]))


def held_out(vectors: DataFrame, queries: DataFrame, rows: int, salt: str) -> DataFrame:
    """About `rows` vectors, chosen by hash, as queries(query_id, q); those that ask are not among them."""
    n = max(1, vectors.count())
    some = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)) < 2 * rows).where("embedding is not null")
    some = some.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).join(queries.select("query_id"), "query_id", "left_anti")
    return some.orderBy(F.xxhash64("query_id", F.lit(salt)), "query_id").limit(rows)


def nearest_by_centroid(queries: DataFrame, vectors: DataFrame, k: int, recall: float = 0.95, rows: int = 4096, tune: int = 256, seed: int = 0, block: int = 1 << 13) -> DataFrame:
    """Approximate nearest neighbours by inverted lists: vectors are filed under their nearest centroid (k-means on a
    sample of at most about `rows` vectors, or 16 a list), and a query looks into the lists nearest to it. Same columns as
    nearest().

    There are about as many lists as the root of the number of vectors, 16 to 1024. How many of them a query looks into is
    tuned on at most `tune` other vectors, chosen by hash: their true neighbours are found exactly, in one scan, and the
    fewest lists that hold the share `recall` of these are looked into. No query that asks is searched exactly; recall is
    set above what is to be reached, as it is an estimate.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = vectors.select("vec_id", "embedding")
    n = max(1, vectors.count())
    many = min(1024, max(16, math.isqrt(n)))
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) < max(rows, 16 * many)).where("embedding is not null")
    model = KMeans(k=many, seed=seed, featuresCol="f", maxIter=10).fit(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("f")))
    centers = np.array(model.clusterCenters())
    filed = written(listed(vectors, "embedding", centers, 1).select("vec_id", "embedding", F.col("lists")[0].alias("list")), "inverted-lists")
    asked_to_tune = written(held_out(vectors, queries, tune, "tune"), "tuning-queries")
    exact = nearest(asked_to_tune, vectors, k + 1).where("vec_id <> query_id").select("query_id", "vec_id")
    ordered = listed(asked_to_tune, "q", centers, len(centers)).select("query_id", "lists")
    place = F.array_position("lists", F.col("list")).cast("int")
    places = exact.join(ordered, "query_id").join(filed.select("vec_id", "list"), "vec_id").groupBy(place.alias("place")).count()
    counts = np.zeros(len(centers), np.int64)
    for r in places.collect():  # a row a list at most
        counts[r["place"] - 1] = r["count"]
    found = np.cumsum(counts)
    probes = int(np.searchsorted(found, recall * found[-1])) + 1 if found[-1] else len(centers)
    # A list meets its queries in parts of about `block` vectors, so a list of very many is no task of its own.
    sizes = filed.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    asked = listed(queries.select("query_id", "q"), "q", centers, probes).select("query_id", F.col("q").cast("array<double>").alias("q"), F.explode("lists").alias("list"))
    asked = asked.join(F.broadcast(sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))  # at most 1024 lists
    dealt = filed.toDF(*filed.columns).select("list", F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    dealt = dealt.join(F.broadcast(sizes.toDF("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def meet(asking: pa.Table, held: pa.Table) -> pa.Table:
        places, units = _units(asking.column("q").combine_chunks())
        best, ids = Best(len(places), k), asking.column("query_id").to_numpy()[places]
        for batch in held.combine_chunks().to_batches() if len(places) else ():
            _scored(best, units, batch)
        at, found, scores, _ = best.taken()
        return pa.table({"query_id": pa.array(ids[at].astype(np.int64)), "vec_id": pa.array(found.astype(np.int64)), "score": pa.array(scores)})

    scored = asked.groupBy("list", "part").cogroup(dealt.groupBy("list", "part")).applyInArrow(meet, "query_id long, vec_id long, score double")
    return top(scored, ["query_id"], k, F.desc("score"), F.asc("vec_id"))
