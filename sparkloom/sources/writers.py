"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Append rows as Parquet, in partitions by one column if named."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def report(df: DataFrame, path: str) -> None:
    """A report as CSV with a header and as JSON lines, side by side."""
    df.write.mode("overwrite").csv(f"{path}/csv", header=True)
    df.write.mode("overwrite").json(f"{path}/json")


def with_maintained_columns(df: DataFrame) -> DataFrame:
    """Kept at every write: the time of the last change."""
    return df.withColumn("updated_at", F.current_timestamp())
