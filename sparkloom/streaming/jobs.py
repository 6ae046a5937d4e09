"""Structured Streaming jobs, and running one to the end of what there is."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text
from ..operators.dedup import first_per
from ..sources.shared import shared_path


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A given table as a stream of its files, with the schema of the files fixed beforehand."""
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if all(file.rstrip("/").endswith(f"/{name}.parquet") for file in batch.inputFiles()):  # one file, not a folder of files
        reader, path = reader.option("pathGlobFilter", f"{name}.parquet"), sf_dir
    stream = reader.parquet(path)
    clocks = [f.name for f in batch.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in clocks}) if clocks else stream


def drained(stream: DataFrame, mode: str = "append", label: str = "stream") -> DataFrame:
    """Run a stream over all input there is and return what it wrote. Append output goes to a file sink, whose log makes
    it exactly-once; in complete mode each trigger's table replaces the one before."""
    spark = stream.sparkSession
    path = shared_path(spark, label)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-progress")
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(path)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def ingest(stream: DataFrame, ledger: str, size: int = 600) -> Callable[[DataFrame, int], None]:
    """The work of one micro-batch of continuous ingestion: gate, drop documents whose content hash the batch or the ledger
    has, cut chunks, and add the chunks whose hash is new (a known chunk has the same content, so there is nothing to
    overwrite). The ledger holds chunk rows. A repeated batch finds its own hashes and adds nothing."""
    schema = "chunk_hash string, content_hash string, doc_id bigint, chunk_no bigint, chunk string"

    def work(batch: DataFrame, _: int) -> None:
        kind = F.when(F.col("doc_id") % 7 == 0, "glossary").otherwise("manual")
        good = batch.where(F.size(text.quality("text", kind)["reasons"]) == 0)
        hashed = good.select(F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"), "doc_id", "text")
        known = batch.sparkSession.read.schema(schema).parquet(ledger)
        new = first_per(hashed, F.col("content_hash"), F.col("doc_id")).join(known, "content_hash", "left_anti")
        parts = F.sequence(F.lit(0).cast("long"), F.ceil(F.length("text") / float(size)) - 1)
        rows = new.select("content_hash", "doc_id", "text", F.explode(parts).alias("chunk_no")).withColumn("chunk", F.substring("text", F.col("chunk_no").cast("int") * size + 1, F.lit(size)))
        rows = rows.select(F.substring(F.sha2("chunk", 256), 1, 16).alias("chunk_hash"), "content_hash", "doc_id", "chunk_no", "chunk")
        first_per(rows, F.col("chunk_hash"), F.struct("doc_id", "chunk_no")).join(known, "chunk_hash", "left_anti").write.mode("append").parquet(ledger)

    stream.sparkSession.createDataFrame([], schema).write.parquet(ledger)
    return work


def unique(stream: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """First of each key within a span of event time; state older than that is dropped."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def daily(stream: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts and means per day and bucket; a day comes out once it is closed, rows later than `late` are dropped."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), F.col("event_type").alias("bucket"))
    out = windows.agg(F.count("*").alias("n"), F.round(F.avg("value") + 1e-9, 4).alias("mean"), F.round(F.avg((F.col("user_id") % 5 == 0).cast("double")), 4).alias("fallback"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "bucket", "n", "mean", "fallback")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by a gap in event time."""
    grouped = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def compaction(stream: DataFrame, most: int = 4, keep: int = 2) -> DataFrame:
    """Turns to compact: when a conversation holds more than `most`, all but its newest `keep`. State: the turns held."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for batch in batches:
            held.extend(int(t) for t in batch["turn"])
        held.sort()
        out = held[:-keep] if len(held) > most else []
        state.update((json.dumps(held[len(out) :]),))
        yield pd.DataFrame({"conv_id": [key[0]] * len(out), "turn": out}).astype("int64")

    return stream.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long", "held string", "append", GroupStateTimeout.NoTimeout)
