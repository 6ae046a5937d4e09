"""Streaming jobs over the given tables, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs, state
from . import windows  # noqa: F401  (its oracles are used here)
from .base import ORACLES, query
from .filters import GATE_SQL


@query("WITH " + GATE_SQL + """, u AS (SELECT substr(sha256(text), 1, 16) AS content_hash, min(doc_id) AS doc_id FROM documents JOIN g USING (doc_id) WHERE reasons = '' GROUP BY content_hash),
  c AS (SELECT content_hash, doc_id, text, unnest(range(0, CAST(ceil(length(text) / 600.0) AS BIGINT))) AS chunk_no FROM u JOIN documents USING (doc_id)),
  h AS (SELECT content_hash, doc_id, chunk_no, substr(text, chunk_no * 600 + 1, 600) AS chunk FROM c)
  SELECT substr(sha256(chunk), 1, 16) AS chunk_hash, content_hash, doc_id, chunk_no, chunk FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, chunk_no) AS r FROM h) WHERE r = 1""")
def str_01(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous ingestion: the chunk rows that the ledger holds at the end."""
    stream = jobs.table_stream(spark, sf, "documents")
    ledger = jobs.shared_path(spark, "ledger")
    work = jobs.ingest(stream, ledger)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{ledger}-progress").foreachBatch(work).start().awaitTermination()
    return spark.read.parquet(ledger)


@query("SELECT DISTINCT user_id, event_type, props FROM events")
def str_02(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicate suppression over a span of event time."""
    stream = jobs.table_stream(spark, sf, "events")
    return jobs.drained(jobs.unique(stream, ["user_id", "event_type", "props"], "ts", "60 days").select("user_id", "event_type", "props"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'converting' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
    CASE WHEN event_id % 3 <> 0 THEN round(value, 2) END AS chunks, CASE WHEN event_id % 4 = 1 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS pages FROM events),
  o AS (SELECT *, CASE status WHEN 'queued' THEN 0 WHEN 'converting' THEN 1 WHEN 'processing' THEN 2 ELSE 3 END AS r FROM e WHERE status IS NOT NULL), b AS (SELECT *, lag(r) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM o),
  k AS (SELECT user_id, arg_max(status, struct_pack(a := ts, b := event_id)) AS status, count(*) FILTER (WHERE r < before) AS steps_back FROM b GROUP BY user_id),
  c AS (SELECT user_id, arg_max(chunks, struct_pack(a := ts, b := event_id)) FILTER (WHERE chunks IS NOT NULL) AS chunks, arg_max(pages, struct_pack(a := ts, b := event_id)) FILTER (WHERE pages IS NOT NULL) AS pages FROM e GROUP BY user_id)
  SELECT c.user_id AS job_id, status, coalesce(steps_back, 0) AS steps_back, chunks, pages FROM c LEFT JOIN k ON c.user_id = k.user_id""")
def str_03(spark: SparkSession, sf: str) -> DataFrame:
    """Job status as state: the last status of each job, how often one stepped back, and counters that only change when
    given. Users stand for jobs, kinds of events for statuses; a counter is left out of some events."""
    status = F.create_map(*[F.lit(x) for pair in (("signup", "queued"), ("view", "converting"), ("click", "processing"), ("purchase", "completed"), ("error", "failed")) for x in pair])
    stream = jobs.table_stream(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), "ts", "event_id", F.try_element_at(status, F.col("event_type")).alias("status"),
        F.when(F.col("event_id") % 3 != 0, F.round("value", 2)).alias("chunks"), F.when(F.col("event_id") % 4 == 1, F.get_json_object("props", "$.k").cast("double")).alias("pages"),
    )
    return state.job_status(stream, ("chunks", "pages"))


@query("SELECT strftime(d, '%Y-%m-%d') AS day, bucket, n, mean, fallback FROM (SELECT date_trunc('day', ts) AS d, event_type AS bucket, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean, round(avg(CASE WHEN user_id % 5 = 0 THEN 1.0 ELSE 0.0 END), 4) AS fallback FROM events GROUP BY d, bucket) WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def str_04(spark: SparkSession, sf: str) -> DataFrame:
    """Daily KPIs; closed days only."""
    return jobs.drained(jobs.daily(jobs.table_stream(spark, sf, "events")))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE n > 4 AND r <= n - 2")
def str_05(spark: SparkSession, sf: str) -> DataFrame:
    """Memory compaction as state."""
    return jobs.drained(jobs.compaction(jobs.table_stream(spark, sf, "conversations").select("conv_id", "turn")))


@query(ORACLES["win_05"])
def str_06(spark: SparkSession, sf: str) -> DataFrame:
    """Adaptive timeouts as state."""
    return state.timeouts(jobs.table_stream(spark, sf, "events").select("event_type", "event_id", "ts", "value"))


@query(ORACLES["win_06"])
def str_06_streaks(spark: SparkSession, sf: str) -> DataFrame:
    """Failure streaks as state: the other half of STR-06."""
    return state.streaks(jobs.table_stream(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, start, n FROM (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k) WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def str_07(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions; closed ones only."""
    return jobs.drained(jobs.sessions(jobs.table_stream(spark, sf, "events")))
