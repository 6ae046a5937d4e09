"""Upserts and merges as joins: returning the table as it is afterwards, or in place, by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.shared import written
from .dedup import first_per


def upsert(target: DataFrame, source: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(table afterwards, counts). The last source row of a key by `order` wins over the target. counts(processed,
    inserted, updated): the first new row of an unknown key is an insert, all other rows are updates."""
    newest = first_per(source, F.col(key), -F.col(order))
    after = target.join(newest, key, "left_anti").select(*source.columns).unionByName(newest)
    flagged = source.groupBy(key).agg(F.count("*").alias("n")).join(target.select(key, F.lit(True).alias("known")), key, "left")
    inserted = F.count_if(F.col("known").isNull())
    counts = flagged.agg(F.sum("n").alias("processed"), inserted.alias("inserted"), (F.sum("n") - inserted).alias("updated"))
    return after, counts


def insert_absent(target: DataFrame, source: DataFrame, key: str, order: str) -> DataFrame:
    """Target plus the source rows whose key it lacks, the first of each by `order`."""
    new = first_per(source.join(target, key, "left_anti"), F.col(key), F.col(order))
    return target.unionByName(new)


def checked_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row with both counts; reading it fails when the target has fewer rows."""
    both = source.agg(F.count("*").alias("src")).join(F.broadcast(target.agg(F.count("*").alias("dst"))))  # one row
    return both.where(F.when(F.col("dst") >= F.col("src"), True).otherwise(F.raise_error(F.lit("target has fewer rows than its source"))))


def restore_if_empty(target: DataFrame, backup: DataFrame) -> DataFrame:
    """The backup's rows when the target has none, else the target's."""
    some = target.limit(1).select(F.lit(1).alias("_some"))
    return target.unionByName(backup.join(F.broadcast(some), F.lit(True), "left_anti"))  # at most one row


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def in_buckets(rows: DataFrame, key: str, path: str, buckets: int) -> None:
    """Write a table in folders by hash bucket of its key, one file a bucket and task that holds it."""
    rows.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def upsert_in_place(path: str, source: DataFrame, key: str, order: str, buckets: int) -> dict[str, int]:
    """Upsert into a table that in_buckets() wrote, rewriting only the buckets in which a row changes; files of all others
    keep their names. The last source row of a key by `order` wins over the stored one; a row that equals the stored one
    changes nothing, so a batch that is given twice writes nothing the second time. Source columns are those of the table;
    rows without a key are left out. Counts as in upsert(), and how many buckets were rewritten.

    What goes into the changed buckets is written aside first, so the table is read to the end before a file of it goes;
    if the job dies in between, running it again gives the same table. Collected are bucket numbers and one row of counts."""
    spark = source.sparkSession
    columns = source.columns
    source = source.where(F.col(key).isNotNull())
    staged = written(source.withColumn("bucket", bucket_of(key, buckets)), "upsert-source")
    touched = [r.bucket for r in staged.select("bucket").distinct().collect()]
    stored = spark.read.schema(StructType([*source.schema.fields, StructField("bucket", IntegerType())])).parquet(path).where(F.col("bucket").isin(touched))
    newest = first_per(staged, F.col(key), -F.col(order))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}"))
    changed = newest.alias("n").join(stored.alias("s"), F.col(f"n.{key}") == F.col(f"s.{key}"), "left").where(F.col(f"s.{key}").isNull() | ~same).select("n.*")
    changed = written(changed, "upsert-changed")
    counts = staged.groupBy(key).agg(F.count("*").alias("n")).join(stored.select(key, F.lit(True).alias("known")), key, "left")
    inserted = F.count_if(F.col("known").isNull())
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("processed"), inserted.alias("inserted")).first()
    dirty = [r.bucket for r in changed.select("bucket").distinct().collect()]
    if dirty:
        rest = stored.where(F.col("bucket").isin(dirty)).join(changed, key, "left_anti")
        after = written(rest.select(*columns, "bucket").unionByName(changed.select(*columns, "bucket")), "upsert-buckets")
        after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return {"processed": total.processed, "inserted": total.inserted, "updated": total.processed - total.inserted, "rewritten": len(dirty)}
