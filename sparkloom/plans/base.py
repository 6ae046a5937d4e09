"""Registering queries: a function (spark, sf_dir) -> DataFrame, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name; sql is the oracle, None where SQL cannot state it."""

    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def read(spark: SparkSession, sf_dir: str, *names: str):
    frames = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return frames[0] if len(frames) == 1 else frames
