"""Aggregate building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written


def exact_percentiles(df: DataFrame, by: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """Exact percentiles with linear interpolation of each group, named p50, p95 and so on; nulls take no part.

    Rows are first counted per (group, value), with a partial count in each task. The counts are dealt by ranges of group
    and value and written, so a group of any number of values spreads over parts. The sums of the parts, one row a group and
    part, say which parts hold the wanted ranks; only these are read again and counted through. No task sorts a group.
    """
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    counted = written(counted.repartitionByRange(*names, "_v").withColumn("_part", F.spark_partition_id()), "percentiles")
    parts = counted.groupBy(*names, "_part").agg(F.sum("_n").alias("_here"))
    group = Window.partitionBy(*names)
    parts = parts.withColumn("_all", F.sum("_here").over(group)).withColumn("_before", F.sum("_here").over(group.orderBy("_part")) - F.col("_here"))
    ranks = F.array(*[f((F.col("_all") - 1) * p).cast("long") for p in points for f in (F.floor, F.ceil)])
    wanted = parts.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_here")))).where("size(_ranks) > 0")
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*names, "_part"]]
    held = counted.alias("c").join(wanted.alias("w"), same).select("c.*", "_all", "_before", "_ranks")
    held = held.withColumn("_end", F.col("_before") + F.sum("_n").over(Window.partitionBy(*names, "_part").orderBy("_v")))
    found = held.select(*names, "_all", "_v", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end")))).alias("_rank"))
    out = []
    for p in points:
        at = (F.col("_all") - 1) * p
        a, b = (F.max(F.when(F.col("_rank") == f(at).cast("long"), F.col("_v"))) for f in (F.floor, F.ceil))
        out.append((a + (b - a) * F.max(at - F.floor(at))).alias(f"p{round(100 * p):d}"))
    made = found.groupBy(*names).agg(*out)
    return made.select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(by)], *[f"p{round(100 * p):d}" for p in points])


def rate(condition: Column) -> Column:
    """Share of rows, in percent."""
    return 100 * F.avg(condition.cast("double"))


def by_and_total(df: DataFrame, by: str, *measures: Column) -> DataFrame:
    """Measures per group and over all rows (group null), in one pass."""
    return df.rollup(by).agg(*measures, F.grouping(by).cast("int").alias("total"))
