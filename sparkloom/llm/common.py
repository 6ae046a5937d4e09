"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path is only ever opened by Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is missing and Spark runs inside one machine (tests) a temporary folder is made; a cluster
    without the setting is an error, as its executors would not see the driver's folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: work done once, lineage cut, safe when executors go."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(texts: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches that are bounded by bytes as well as by rows, so long texts make short batches.

    Spark has a session setting for that; a session that allows more than BATCH_BYTES is set to it.
    """
    conf = df.sparkSession.conf
    allowed = re.match(r"(-?\d+)\s*([kmgtp]?)", conf.get(BATCH_SETTING).lower())
    size = int(allowed[1]) << 10 * " kmgtp".index(allowed[2] or " ")
    if not 0 < size <= BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """fn applied to each batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return in_arrow(df, run, schema)


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """From batches sorted by keys, batches that never cut a run of equal keys.

    Rows of the last run are held back until the next batch shows that it has ended.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if held:
            same = all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
            if not same:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def run_bounds(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Starts of the runs of equal keys, and the number of rows at the end."""
    change = np.ones(batch.num_rows, bool)
    change[1:] = False
    for key in keys:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(change), batch.num_rows)


def roots_of(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest member of each class of 0..n-1 under the links in pairs (k x 2): a local union-find."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.fromiter((find(i) for i in range(n)), np.int64, n)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a long, b long); component is the smallest node reached.

    Rounds of large-star and small-star steps: each node tells the smallest neighbour it knows to the others, so
    paths halve. A node's neighbours are never gathered; only their minimum is, with a partial aggregate before the
    shuffle, so a node with very many links costs no more than its share of the edge rows. Each round is written to
    the shared folder, so a lost executor costs one round. Null ends and self-links are left out.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    path = fresh_path(spark, "edges")
    pairs.write.parquet(path)
    pairs = spark.read.schema("a long, b long").parquet(path)
    before: tuple | None = None
    while True:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        path = fresh_path(spark, "edges")
        small.where("a <> b").distinct().write.parquet(path)
        pairs = spark.read.schema("a long, b long").parquet(path)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select(F.col("b"), F.col("b")).distinct())
