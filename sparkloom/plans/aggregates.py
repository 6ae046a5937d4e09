"""Aggregations over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import formulas, text
from ..operators.ranking import top
from ..operators.search import search
from ..operators.summaries import by_and_total, exact_percentiles, rate
from ..sources import readers
from .base import query, read
from .filters import BM25_SQL, SEARCHED_SQL, searched, text_hits
from .joins import LISTS_SQL, chunks, questions

VERDICT = "CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN toxic = 1 THEN 'incorrect' ELSE 'partial' END"
POINTS = "CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN toxic = 1 THEN 0.0 ELSE 0.5 END"


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as verdicts with points."""
    labels = read(spark, sf, "labels")
    good, bad = (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("toxic") == 1
    return labels.withColumn("verdict", F.when(good, "correct").when(bad, "incorrect").otherwise("partial")).withColumn("points", F.when(good, 1.0).when(bad, 0.0).otherwise(0.5))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS positive, count(*) FILTER (WHERE value < 10) AS negative, round(avg(value) + 1e-9, 3) AS mean FROM events GROUP BY event_type, day")
def agg_01(spark: SparkSession, sf: str) -> DataFrame:
    """Daily usage."""
    return read(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("positive"), F.count_if(F.col("value") < 10).alias("negative"), F.round(F.avg("value") + 1e-9, 3).alias("mean"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type AS bucket, count(*) AS n, round(avg(least(value / 100, 1)), 4) AS confidence, round(avg(value) + 1e-9, 3) AS mean, round(quantile_cont(value, 0.95) + 1e-9, 3) AS p95, round(avg(0.0013::DOUBLE + greatest(1, user_id % 5) * 0.0015::DOUBLE) + 1e-12, 6) AS cost, round(avg(CASE WHEN user_id % 5 = 0 THEN 1.0 ELSE 0.0 END), 4) AS fallback FROM events GROUP BY day, bucket")
def agg_02(spark: SparkSession, sf: str) -> DataFrame:
    """Daily routing quality per bucket, with the mean cost of a call."""
    e = read(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("bucket"), "value", "user_id")
    means = e.groupBy("day", "bucket").agg(F.count("*").alias("n"), F.round(F.avg(F.least(F.col("value") / 100, F.lit(1.0))), 4).alias("confidence"), F.round(F.avg("value") + 1e-9, 3).alias("mean"), F.round(F.avg(formulas.routing_cost(F.col("user_id") % 5, F.lit(0))) + 1e-12, 6).alias("cost"), F.round(F.avg((F.col("user_id") % 5 == 0).cast("double")), 4).alias("fallback"))
    p95 = exact_percentiles(e, ["day", "bucket"], "value", (0.95,)).select("day", "bucket", F.round(F.col("p95") + 1e-9, 3).alias("p95"))
    return means.join(p95, ["day", "bucket"], "left").select("day", "bucket", "n", "confidence", "mean", "p95", "cost", "fallback")


@query(f"SELECT d.source, count(*) AS n, round(avg({POINTS}), 4) AS mean_score, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS bad, count(*) FILTER (WHERE {VERDICT} = 'partial') AS part FROM labels JOIN documents AS d USING (doc_id) GROUP BY d.source")
def agg_03(spark: SparkSession, sf: str) -> DataFrame:
    """Session quality, sessions being the sources: count, mean score and the three sums."""
    joined = verdicts(spark, sf).join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("points"), 4).alias("mean_score"), F.sum("quality").alias("good"), F.sum("toxic").alias("bad"), F.count_if(F.col("verdict") == "partial").alias("part"))


@query(f"SELECT doc_id % 10 AS session, count(*) FILTER (WHERE {VERDICT} = 'correct') AS correct, count(*) FILTER (WHERE {VERDICT} = 'partial') AS part, count(*) FILTER (WHERE {VERDICT} = 'incorrect') AS incorrect, round(100 * sum({POINTS}) / count(*) + 1e-9) AS score FROM labels GROUP BY session")
def agg_04(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict metrics per session."""
    counts = [F.count_if(F.col("verdict") == v).alias(n) for v, n in (("correct", "correct"), ("partial", "part"), ("incorrect", "incorrect"))]
    return verdicts(spark, sf).groupBy((F.col("doc_id") % 10).alias("session")).agg(*counts, F.round(F.coalesce(100 * F.sum("points") / F.count("*"), F.lit(0.0)) + 1e-9).alias("score"))


@query("SELECT * FROM (SELECT 'total' AS kind, CAST(count(*) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS b, round(avg(o_totalprice), 2) AS c FROM orders) UNION ALL SELECT * FROM (SELECT 'top' AS kind, CAST(o_orderkey AS DOUBLE) AS a, o_totalprice AS b, NULL AS c FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)")
def agg_05(spark: SparkSession, sf: str) -> DataFrame:
    """Dashboard totals, and the three best sessions."""
    o = read(spark, sf, "orders")
    totals = o.agg(F.lit("total").alias("kind"), F.count("*").cast("double").alias("a"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("b"), F.round(F.avg("o_totalprice"), 2).alias("c"))
    best = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).select(F.lit("top").alias("kind"), F.col("o_orderkey").cast("double").alias("a"), F.col("o_totalprice").alias("b"), F.lit(None).cast("double").alias("c"))
    return totals.union(best)


ROUTED_SQL = SEARCHED_SQL.format(k=4) + ", routed AS (SELECT query_id, any_value(q.label) AS expected, list(h.label ORDER BY rank) AS plan, max(score) FILTER (WHERE rank > 1) AS best FROM hits AS h JOIN embeddings AS q ON h.query_id = q.vec_id WHERE h.vec_id <> h.query_id GROUP BY query_id)"


def routed(spark: SparkSession, sf: str) -> DataFrame:
    """A routing benchmark from search output: expected is the query's label, the plan is the labels of its hits in order."""
    labels = read(spark, sf, "embeddings").select("vec_id", "label")
    hits = searched(spark, sf, 4).where("vec_id <> query_id").join(labels, "vec_id")
    plans = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("plan"), F.max(F.when(F.col("rank") > 1, F.col("score"))).alias("best"))
    return plans.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected")), "query_id")


@query("WITH " + ROUTED_SQL + ", done AS (SELECT * FROM routed WHERE query_id % 400 <> 300) SELECT count(*) AS n, (SELECT count(*) FROM routed WHERE query_id % 400 = 300) AS failed, round(avg(best), 6) AS mean, round(100 * avg(CASE WHEN plan[1] = expected THEN 1.0 ELSE 0 END), 4) AS r1, round(100 * avg(CASE WHEN list_contains(plan[1:3], expected) THEN 1.0 ELSE 0 END), 4) AS r3, round(100 * avg(CASE WHEN best < 0.4 THEN 1.0 ELSE 0 END), 4) AS fallback, round(quantile_cont(best, 0.5), 6) AS p50, round(quantile_cont(best, 0.95), 6) AS p95, round(quantile_cont(best, 0.99), 6) AS p99 FROM done")
def agg_06(spark: SparkSession, sf: str) -> DataFrame:
    """Routing benchmark summary; failed cases (by id here) are counted and take no part in the rest."""
    every = routed(spark, sf)
    failed = every.agg(F.count_if(F.col("query_id") % 400 == 300).alias("failed"))  # one row
    r = every.where("query_id % 400 <> 300")
    summary = r.agg(F.count("*").alias("n"), F.round(F.avg("best"), 6).alias("mean"), F.round(rate(F.col("plan")[0] == F.col("expected")), 4).alias("r1"), F.round(rate(F.expr("array_contains(slice(plan, 1, 3), expected)")), 4).alias("r3"), F.round(rate(F.col("best") < 0.4), 4).alias("fallback"), *[F.round(F.percentile("best", p), 6).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])
    return summary.join(F.broadcast(failed))


@query("WITH " + ROUTED_SQL + " SELECT expected, grouping(expected) AS total, count(*) AS n, round(100 * avg(CASE WHEN plan[1] = expected THEN 1.0 ELSE 0 END), 4) AS r1 FROM routed GROUP BY ROLLUP(expected)")
def agg_07(spark: SparkSession, sf: str) -> DataFrame:
    """The same per expected agent and in total, in one pass."""
    return by_and_total(routed(spark, sf), "expected", F.count("*").alias("n"), F.round(rate(F.col("plan")[0] == F.col("expected")), 4).alias("r1"))


@query("WITH " + ROUTED_SQL + " SELECT expected, plan[1] AS got, count(*) AS n FROM routed WHERE plan[1] <> expected GROUP BY expected, got ORDER BY n DESC, expected, got LIMIT 20")
def agg_08(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty commonest confusions."""
    pairs = routed(spark, sf).select("expected", F.col("plan")[0].alias("got")).where("expected <> got")
    return pairs.groupBy("expected", "got").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "expected", "got").limit(20)


@query("SELECT substr(string_split(text, chr(10))[1], 1, 120) AS error, count(*) AS n FROM documents GROUP BY error")
def agg_09(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of first lines."""
    return read(spark, sf, "documents").groupBy(F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 120).alias("error")).agg(F.count("*").alias("n"))


WANTED = ("en", "de", "fr", "es", "it", "pt")


@query("SELECT lang, source, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 4) AS share, CAST(grouping(lang) + 2 * grouping(source) AS INTEGER) AS level FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source)) UNION ALL SELECT l, NULL, 0, 0, 4 FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('it'), ('pt')) AS v(l) WHERE l NOT IN (SELECT lang FROM documents) UNION ALL SELECT NULL, NULL, count(*) FILTER (WHERE quality = 1 AND toxic = 1), round(100.0 * count(*) FILTER (WHERE quality = 1 AND toxic = 1) / count(*), 4), 5 FROM labels UNION ALL SELECT NULL, NULL, count(*) FILTER (WHERE quality = 0 AND toxic = 0), round(100.0 * count(*) FILTER (WHERE quality = 0 AND toxic = 0) / count(*), 4), 6 FROM labels")
def agg_10(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage by language, source and both, with shares; then languages that are wanted and missing (level 4), and labelled
    rows with several or no expectations (5 and 6; what a label expects are its marks)."""
    docs = read(spark, sf, "documents")
    sets = docs.groupingSets([["lang"], ["source"], ["lang", "source"]], "lang", "source").agg(F.count("*").alias("n"), (F.grouping("lang") + 2 * F.grouping("source")).cast("int").alias("level"))
    whole = docs.agg(F.count("*").alias("all"))  # one row
    shares = sets.join(F.broadcast(whole)).select("lang", "source", "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("share"), "level")
    none = F.lit(None).cast("string")
    missing = spark.createDataFrame([(x,) for x in WANTED], "lang string").join(docs.select("lang"), "lang", "left_anti")
    missing = missing.select("lang", none.alias("source"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("share"), F.lit(4).alias("level"))
    expected = read(spark, sf, "labels").select(F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"))).alias("e"))
    for level, size in ((5, 2), (6, 0)):
        n = F.count_if(F.size("e") == size)
        missing = missing.union(expected.agg(n.alias("n"), F.round(100.0 * n / F.count("*"), 4).alias("share")).select(none, none, "n", "share", F.lit(level)))
    return shares.union(missing)


FOUND_SQL = BM25_SQL + ", found AS (SELECT b.item_id, b.item_id % 4 AS agent, coalesce(bool_or(contains(d.text, b.text)), false) AS hit FROM benchmark AS b LEFT JOIN bm ON bm.query_id = b.item_id AND bm.rank <= 5 LEFT JOIN documents AS d ON d.doc_id = bm.doc_id GROUP BY b.item_id)"


def found_items(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, agent, hit: whether one of the five best documents of a benchmark text holds it whole."""
    items, docs = read(spark, sf, "benchmark", "documents")
    items = items.select("item_id", F.col("text").alias("asked"))
    rows = text_hits(spark, sf, 5).select(F.col("query_id").alias("item_id"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").join(items, "item_id")
    held = rows.groupBy("item_id").agg(F.bool_or(F.contains("text", "asked")).alias("held"))
    return items.join(held, "item_id", "left").select("item_id", (F.col("item_id") % 4).alias("agent"), F.coalesce("held", F.lit(False)).alias("hit"))


@query("WITH " + FOUND_SQL + " SELECT agent, grouping(agent) AS total, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(100 * avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 4) AS percent FROM found GROUP BY ROLLUP(agent)")
def agg_11(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval coverage per agent and in total: items whose whole text is in one of the documents found for it."""
    hit = F.col("hit")
    return by_and_total(found_items(spark, sf), "agent", F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(rate(hit), 4).alias("percent"))


@query("WITH " + FOUND_SQL + " SELECT item_id, agent FROM found WHERE NOT hit")
def agg_11_misses(spark: SparkSession, sf: str) -> DataFrame:
    """The list of misses."""
    return found_items(spark, sf).where("not hit").select("item_id", "agent")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 1) AS success, round(avg(value) + 1e-9, 3) AS mean, min(value) AS low, max(value) AS high, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS p{p}" for p in (50, 90, 95, 99)) + " FROM events GROUP BY event_type")
def agg_12(spark: SparkSession, sf: str) -> DataFrame:
    """Latency summary."""
    e, points = read(spark, sf, "events").select("event_type", "value"), (0.5, 0.9, 0.95, 0.99)
    means = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 1).alias("success"), F.round(F.avg("value") + 1e-9, 3).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    exact = exact_percentiles(e, ["event_type"], "value", points)
    return means.join(exact.select("event_type", *(F.round(c, 4).alias(c) for c in exact.columns[1:])), "event_type", "left")


EXPERIMENTS_SQL = LISTS_SQL + """, fused AS (SELECT query_id, vec_id, round(sum(s), 12) AS score FROM (SELECT query_id, vec_id, 1.5::DOUBLE / (60 + rank) AS s FROM hits WHERE rank <= 15 UNION ALL SELECT query_id, vec_id, 1.0::DOUBLE / (60 + rank) FROM txt WHERE rank <= 15) GROUP BY query_id, vec_id),
  ranks AS (SELECT 'vector' AS experiment, query_id, vec_id, rank FROM hits UNION ALL SELECT 'text', query_id, vec_id, rank FROM txt UNION ALL SELECT 'hybrid', query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) FROM fused),
  runs AS (SELECT e.experiment, q.label AS agent, q.vec_id AS query_id, max(CASE WHEN v.label = q.label THEN 1.0 ELSE 0.0 END) AS hit FROM (VALUES ('vector'), ('text'), ('hybrid')) AS e(experiment) JOIN embeddings AS q ON q.vec_id % 100 = 0
    LEFT JOIN ranks AS r ON r.experiment = e.experiment AND r.query_id = q.vec_id AND r.rank <= 5 AND r.vec_id <> r.query_id LEFT JOIN embeddings AS v ON v.vec_id = r.vec_id GROUP BY ALL)"""


def experiment_runs(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """One row per kind of search and query: whether another row of the query's label is among the first k that this kind of
    search finds. Each kind is searched for real, at the same k."""
    labels = read(spark, sf, "embeddings").select("vec_id", "label")
    asked = labels.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("agent"))
    runs = []
    for kind in readers.SEARCHES:
        rows = search(questions(spark, sf), chunks(spark, sf), kind, k).select("query_id", "vec_id").where("vec_id <> query_id").join(labels, "vec_id")
        hits = asked.join(rows, "query_id", "left").groupBy("query_id", "agent").agg(F.max(F.coalesce(F.col("label") == F.col("agent"), F.lit(False)).cast("double")).alias("hit"))
        runs.append(hits.select(F.lit(kind).alias("experiment"), "agent", "query_id", "hit"))
    return reduce(DataFrame.unionByName, runs)


@query("WITH " + EXPERIMENTS_SQL + " SELECT experiment, agent, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 4) AS hit_rate FROM runs GROUP BY experiment, agent")
def agg_13(spark: SparkSession, sf: str) -> DataFrame:
    """Experiment results per agent: vector, text and hybrid search at the same k."""
    return experiment_runs(spark, sf).groupBy("experiment", "agent").agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("hits"), F.round(F.avg("hit"), 4).alias("hit_rate"))


@query("WITH " + EXPERIMENTS_SQL + ", p AS (SELECT agent, round(avg(hit) FILTER (WHERE experiment = 'vector'), 4) AS vector, round(avg(hit) FILTER (WHERE experiment = 'text'), 4) AS text, round(avg(hit) FILTER (WHERE experiment = 'hybrid'), 4) AS hybrid FROM runs GROUP BY agent) SELECT *, CASE WHEN vector = greatest(vector, text, hybrid) THEN 'vector' WHEN text = greatest(vector, text, hybrid) THEN 'text' ELSE 'hybrid' END AS best FROM p")
def agg_14(spark: SparkSession, sf: str) -> DataFrame:
    """Strategies side by side, and the best one."""
    kinds = ["vector", "text", "hybrid"]
    p = experiment_runs(spark, sf).groupBy("agent").pivot("experiment", kinds).agg(F.round(F.avg("hit"), 4))
    most = F.greatest(*kinds)
    return p.withColumn("best", F.when(F.col("vector") == most, "vector").when(F.col("text") == most, "text").otherwise("hybrid"))


TERM_STATS_SQL = """t AS (SELECT lang AS agent, source AS grp, 1 AS weight, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{4,}'))) AS term FROM documents
    UNION ALL SELECT ['en', 'de', 'fr', 'es'][item_id % 4 + 1], 'asked', 2, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{4,}'))) FROM benchmark),
  a AS (SELECT term, agent, CAST(sum(weight) AS BIGINT) AS support, count(DISTINCT grp) AS groups FROM t GROUP BY term, agent),
  g AS (SELECT term, CAST(sum(weight) AS BIGINT) AS everywhere FROM t GROUP BY term), n AS (SELECT lang AS agent, count(*) AS docs FROM documents GROUP BY lang),
  stats AS (SELECT term, agent, support, everywhere, groups, support / everywhere::DOUBLE AS precision, support / docs::DOUBLE AS coverage, round(pow(support / everywhere::DOUBLE, 2) * ln(1 + support) * ln(1 + groups), 6) AS score FROM a JOIN g USING (term) JOIN n USING (agent))"""


AGENTS = ("en", "de", "fr", "es")


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Support (twice the questions and once the documents that hold a term), precision, coverage and score of every term of an
    agent (a language; questions get one by their id) with a support of two or more."""
    docs = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("agent"), F.col("source").alias("grp"), "text")
    # Counted per (term, agent, group) first; the terms of one document, the largest part, fall to the support cut before any join.
    asked = read(spark, sf, "benchmark").select(F.element_at(F.array(*map(F.lit, AGENTS)), (F.col("item_id") % len(AGENTS) + 1).cast("int")).alias("agent"), F.lit("asked").alias("grp"), "text", F.lit(2).alias("weight"))
    rows = docs.select("agent", "grp", "text", F.lit(1).alias("weight")).unionByName(asked)
    t = rows.select("agent", "grp", "weight", F.explode(text.keywords("text")).alias("term")).groupBy("term", "agent", "grp").agg(F.sum("weight").alias("n"))
    a = t.groupBy("term", "agent").agg(F.sum("n").alias("support"), F.count("grp").alias("groups"))
    w = Window.partitionBy("term")  # a row an agent
    a = a.withColumn("everywhere", F.sum("support").over(w)).where("support >= 2")
    n = docs.groupBy("agent").agg(F.count("*").alias("docs"))
    precision = F.col("support") / F.col("everywhere")
    score = F.pow(precision, F.lit(2)) * F.log1p("support") * F.log1p("groups")
    return a.join(n, "agent").select("term", "agent", "support", "everywhere", "groups", precision.alias("precision"), (F.col("support") / F.col("docs")).alias("coverage"), F.round(score, 6).alias("score"))


@query("WITH " + TERM_STATS_SQL + " SELECT term, agent, support, everywhere, groups, round(precision, 6) AS precision, round(coverage, 6) AS coverage, score FROM stats WHERE support >= 2")
def agg_15(spark: SparkSession, sf: str) -> DataFrame:
    """Term statistics per agent."""
    return term_stats(spark, sf).where("support >= 2").withColumns({c: F.round(c, 6) for c in ("precision", "coverage")})


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS tools, count(*) FILTER (WHERE event_type IN ('view', 'signup')) AS nodes, CASE WHEN bool_or(event_type = 'purchase') THEN 'rag' WHEN bool_or(event_type = 'click') THEN 'tool' ELSE 'model' END AS source, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS names, max(value) AS best, CASE WHEN count(*) >= 2 THEN epoch_us(max(ts)) - epoch_us(min(ts)) END AS latency_us FROM events GROUP BY user_id")
def agg_16(spark: SparkSession, sf: str) -> DataFrame:
    """Trace roll-up: events, tools, nodes, names, best score, latency and the class of the answer's source."""
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("tools"), F.count_if(F.col("event_type").isin("view", "signup")).alias("nodes"), F.when(F.bool_or(F.col("event_type") == "purchase"), "rag").when(F.bool_or(F.col("event_type") == "click"), "tool").otherwise("model").alias("source"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("names"), F.max("value").alias("best"), F.when(F.count("*") >= 2, span).alias("latency_us"))


@query("SELECT conv_id, count(*) AS n, max_by(text, turn) AS last_text, min_by(text, turn) FILTER (WHERE role = 'user' AND trim(text) <> '') AS first_user, max_by(turn, turn) FILTER (WHERE role = 'assistant') AS last_answer FROM conversations GROUP BY conv_id")
def agg_17(spark: SparkSession, sf: str) -> DataFrame:
    """Thread summary."""
    spoken = (F.col("role") == "user") & (F.trim("text") != "")
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by("text", "turn").alias("last_text"), F.min_by("text", F.when(spoken, F.col("turn"))).alias("first_user"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_answer"))


@query("SELECT source, count(*) AS files, CAST(sum(greatest(1, ceil(length(text) / 600.0))) AS BIGINT) AS chunks, count(*) FILTER (WHERE length(trim(text)) < 20) AS errors FROM documents GROUP BY source")
def agg_18(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest totals."""
    return read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.greatest(F.lit(1), F.ceil(F.length("text") / 600.0))).cast("long").alias("chunks"), F.count_if(F.length(F.trim("text")) < 20).alias("errors"))


NUMS_SQL = "list_distinct(list_transform(regexp_extract_all({0}, '\\d[\\d.,]*'), lambda g: regexp_replace(g, '[^\\d]', '', 'g')))"


@query(
    "SELECT count(*) AS pairs, round(avg(CASE WHEN len(list_filter(e, lambda x: NOT list_contains(a, x))) = 0 THEN 1.0 ELSE 0 END), 4) AS preserved, round(avg(CASE WHEN regexp_matches(lower(answer), '(the|der|les)') THEN 1.0 ELSE 0 END), 4) AS forbidden FROM (SELECT a.text AS answer, "
    + NUMS_SQL.format("q.text")
    + " AS e, "
    + NUMS_SQL.format("a.text")
    + " AS a FROM conversations AS q JOIN conversations AS a ON q.conv_id = a.conv_id AND a.turn = q.turn + 1 AND q.role = 'user' AND a.role = 'assistant')"
)
def agg_19(spark: SparkSession, sf: str) -> DataFrame:
    """How often an answer keeps the question's numbers, and holds a forbidden phrase."""
    c = read(spark, sf, "conversations")
    q = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), text.numbers("text").alias("e"))
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"), text.numbers("text").alias("a"))
    return q.join(a, ["conv_id", "turn"]).agg(F.count("*").alias("pairs"), F.round(F.avg((F.size(F.array_except("e", "a")) == 0).cast("double")), 4).alias("preserved"), F.round(F.avg(F.lower("answer").rlike("(the|der|les)").cast("double")), 4).alias("forbidden"))


@query(f"SELECT {VERDICT} AS cause, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END), 4) AS routing_ok, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0 END), 4) AS noise, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0 END), 4) AS factual, round(avg(CASE WHEN quality = 1 AND toxic = 1 THEN 1.0 ELSE 0 END), 4) AS extrapolation, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) >= 0.9 AS pass FROM labels GROUP BY cause")
def agg_20(spark: SparkSession, sf: str) -> DataFrame:
    """Homologation scorecard against targets: routing, facts, noise and extrapolation (a good answer that is toxic) by cause."""
    ok = F.avg((F.col("quality") == 1).cast("double"))
    return verdicts(spark, sf).groupBy(F.col("verdict").alias("cause")).agg(F.count("*").alias("n"), F.round(ok, 4).alias("routing_ok"), F.round(F.avg((F.col("toxic") == 1).cast("double")), 4).alias("noise"), F.round(F.avg(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double")), 4).alias("factual"), F.round(F.avg(((F.col("quality") == 1) & (F.col("toxic") == 1)).cast("double")), 4).alias("extrapolation"), (ok >= 0.9).alias("pass"))


@query("SELECT l_suppkey AS run, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS overall, round(avg(CASE WHEN l_discount <= 0.05 THEN 1.0 ELSE 0 END), 4) AS pass_rate, count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0.08) AS critical, round(avg(l_tax), 6) AS cost, round(avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))), 4) AS latency FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY run")
def agg_21(spark: SparkSession, sf: str) -> DataFrame:
    """Run report with weighted cases; a case's latency is the days from its order to its shipment."""
    cases = read(spark, sf, "lineitem").join(read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return cases.groupBy(F.col("l_suppkey").alias("run")).agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("overall"), F.round(F.avg((F.col("l_discount") <= 0.05).cast("double")), 4).alias("pass_rate"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08)).alias("critical"), F.round(F.avg("l_tax"), 6).alias("cost"), F.round(F.avg(F.date_diff("l_shipdate", "o_orderdate")), 4).alias("latency"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(count(*) AS BIGINT) AS n_chunks, array_to_string(list(substr(text, CAST(s AS BIGINT), 120) ORDER BY s)[1:3], ' / ') AS preview FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 600)) AS s FROM documents) GROUP BY doc_id, text")
def agg_22(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest dry run: characters, chunks and the first three previews per document, computed inside the row."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(600))
    heads = F.transform(F.slice(starts, 1, 3), lambda s: F.substring(F.col("text"), s, F.lit(120)))
    return read(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size(starts).cast("long").alias("n_chunks"), F.array_join(heads, " / ").alias("preview"))
