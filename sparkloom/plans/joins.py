"""Joins over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import phrases, postings, rules, vectors
from ..sources.shared import written
from .base import query, read
from .filters import FOLDED_WORDS_SQL, SEARCHED_SQL, asking, bm25_sql, searched

@query(
    """SELECT c_custkey, count(DISTINCT o_orderkey) AS sessions, count(l_orderkey) AS messages, max(l_shipdate) AS last_seen FROM customer
    LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey"""
)
def jn_01(spark: SparkSession, sf: str) -> DataFrame:
    """User activity over two left joins; messages are counted per session before the join, so nothing fans out."""
    users, sessions, logs = read(spark, sf, "customer", "orders", "lineitem")
    per = logs.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("seen"))
    joined = sessions.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("sessions"), F.sum(F.coalesce("n", F.lit(0))).alias("messages"), F.max("seen").alias("last_seen"))
    out = users.select("c_custkey").join(joined, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("messages", F.lit(0)).alias("messages"), "last_seen")


@query("WITH " + SEARCHED_SQL.format(k=5) + " SELECT query_id, vec_id, score, rank FROM hits")
def jn_02(spark: SparkSession, sf: str) -> DataFrame:
    """Vector nearest neighbours, exact."""
    return searched(spark, sf, 5)


@query()
def jn_03(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate nearest neighbours by inverted lists. Rows with vec_id % 100 = 0 ask; none of them is searched exactly."""
    return vectors.nearest_by_centroid(asking(spark, sf), read(spark, sf, "embeddings").select("vec_id", "embedding"), 5)


@query()
def jn_03_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the inverted lists at k = 5 by query, on at most 256 rows, chosen by hash, that neither ask in jn_03 nor
    were used to tune."""
    v = read(spark, sf, "embeddings").select("vec_id", "embedding")
    tuned = vectors.held_out(v, v.limit(0).select(F.col("vec_id").alias("query_id")), 256, "tune")
    apart = tuned.select("query_id").union(asking(spark, sf).select("query_id"))
    measured = written(vectors.held_out(v, apart, 256, "measure"), "measured-queries")
    near = vectors.nearest_by_centroid(measured, v, 5).select("query_id", "vec_id", F.lit(1).alias("found"))
    exact = vectors.nearest(measured, v, 5).select("query_id", "vec_id")
    return exact.join(near, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("found") / F.count("*")).alias("recall"))


@query(
    f"""WITH d AS (SELECT doc_id, unnest(list_distinct({FOLDED_WORDS_SQL.format('text', 2)})) AS term FROM documents),
    q AS (SELECT item_id, unnest(list_distinct({FOLDED_WORDS_SQL.format('text', 2)})) AS term FROM benchmark),
    n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)
    SELECT item_id, doc_id FROM q JOIN d USING (term) JOIN n USING (item_id) GROUP BY item_id, doc_id, n HAVING count(*) = n"""
)
def jn_04(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold all terms of a query. A document is looked at for a query only if it holds the query's rarest
    term, so common terms pair nothing."""
    docs, asked = read(spark, sf, "documents", "benchmark")
    asked = asked.select(F.col("item_id").alias("query_id"), F.array_distinct(text.folded_words("text")).alias("terms"))
    return postings.holding(asked, docs.select("doc_id", "text")).select(F.col("query_id").alias("item_id"), "doc_id")


def lists_sql(k: int) -> str:
    """hits and txt: the k best rows of every stated query by vector, and by text."""
    bm = bm25_sql("SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL AND doc_id IN (SELECT vec_id FROM embeddings)", "SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
    return f"{SEARCHED_SQL.format(k=k)}, {bm}, txt AS (SELECT query_id, doc_id AS vec_id, rank FROM bm WHERE rank <= {k})"


LISTS_SQL = lists_sql(24)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Searchable rows: vec_id, embedding, domain, and the text of the document with that id, if there is one."""
    v, d = read(spark, sf, "embeddings", "documents")
    return v.join(d.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left").select("vec_id", "embedding", F.col("label").alias("domain"), "text")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """The stated queries over searchable rows: vector and text of every row whose id is divisible by 100."""
    return chunks(spark, sf).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "text")


def text_list(spark: SparkSession, sf: str, k: int = 24) -> DataFrame:
    """The second ranked list of the hybrid search: rows whose text fits the query's text best by BM25."""
    hits = postings.bm25_top(questions(spark, sf).select("query_id", "text"), chunks(spark, sf).select(F.col("vec_id").alias("doc_id"), "text"), k)
    return hits.select("query_id", F.col("doc_id").alias("vec_id"), "rank")


@query("WITH " + LISTS_SQL + " SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.vec_id, t.vec_id) AS vec_id, v.rank AS by_vector, t.rank AS by_text FROM hits AS v FULL JOIN txt AS t ON v.query_id = t.query_id AND v.vec_id = t.vec_id")
def jn_05(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranked lists joined on their key, either side may be missing."""
    v = searched(spark, sf, 24).select("query_id", "vec_id", F.col("rank").alias("by_vector"))
    t = text_list(spark, sf).select("query_id", "vec_id", F.col("rank").alias("by_text"))
    return v.join(t, ["query_id", "vec_id"], "full_outer")


@query("SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) AS known FROM documents WHERE doc_id % 2 = 1")
def jn_06(spark: SparkSession, sf: str) -> DataFrame:
    """New documents against a ledger of file hashes: semi join for known ones, anti join for new ones."""
    docs = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    ledger, fresh = docs.where("doc_id % 2 = 0").select("h"), docs.where("doc_id % 2 = 1")
    return fresh.join(ledger, "h", "left_semi").select("doc_id", F.lit(True).alias("known")).union(fresh.join(ledger, "h", "left_anti").select("doc_id", F.lit(False)))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE event_type <> 'view' OR rn = 1")
def jn_07(spark: SparkSession, sf: str) -> DataFrame:
    """Superseded rows out: of the active ones (views) the latest per user stays, the others are untouched."""
    events = read(spark, sf, "events")
    newest = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rn", F.row_number().over(newest)).where("event_type <> 'view' or rn = 1").select("event_id", "user_id", "event_type")


@query("SELECT c.conv_id, c.turn, t.event_id AS trace FROM conversations AS c LEFT JOIN (SELECT user_id, event_id % 6 AS turn, max_by(event_id, struct_pack(ts := ts, id := event_id)) AS event_id FROM events GROUP BY user_id, event_id % 6) AS t ON c.conv_id = t.user_id AND c.turn = t.turn")
def jn_08(spark: SparkSession, sf: str) -> DataFrame:
    """Each message with the trace of its turn, the last one where there are several (traces name conversation and turn)."""
    traces = read(spark, sf, "events").groupBy(F.col("user_id").alias("conv_id"), (F.col("event_id") % 6).alias("turn")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("trace"))
    return read(spark, sf, "conversations").select("conv_id", "turn").join(traces, ["conv_id", "turn"], "left")


@query("SELECT event_id, user_id, epoch_us(next_ts) - epoch_us(ts) AS latency_us FROM (SELECT *, lead(event_type) OVER w AS next_type, lead(ts) OVER w AS next_ts FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'click' AND next_type = 'purchase'")
def jn_09(spark: SparkSession, sf: str) -> DataFrame:
    """Calls (clicks) with the next result (purchase) of the same user; a later call replaces an unanswered one."""
    events = read(spark, sf, "events").where("event_type in ('click', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = events.withColumn("after", F.lead(F.struct("event_type", "ts")).over(w)).where("event_type = 'click' and after.event_type = 'purchase'")
    return pairs.select("event_id", "user_id", (F.unix_micros(F.col("after.ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("latency_us"))


GRAMS_SQL = f"list_filter({list(rules.TERMS)!r}, lambda x: contains(' ' || array_to_string(w, ' ') || ' ', ' ' || x || ' '))"
WORDS_OF_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


def rule_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, rule_set, kind, term): a trie of all words and phrases is walked over each text, what it finds gets its rule
    sets from the table of rules; the few patterns are tried on each text in its row. Terms that are noise find nothing."""
    known = F.broadcast(rules.table(spark).where("kind <> 'pattern' and rule_set <> 'noise'").where(~F.col("term").isin(*rules.NOISE)))  # fixed and small
    asked = [t for n, kind, t in rules.rows() if kind != "pattern" and n != "noise" and t not in rules.NOISE]
    found = phrases.hits(docs.select("doc_id", text.words(F.lower("text"), 1).alias("w")), "doc_id", "w", asked).join(known, "term")
    tried = [F.when(F.lower("text").rlike(p), F.struct(F.lit(n).alias("rule_set"), F.lit("pattern").alias("kind"), F.lit(p).alias("term"))) for n, kind, p in rules.rows() if kind == "pattern"]
    patterns = docs.select("doc_id", F.explode(F.array_compact(F.array(*tried))).alias("r")).select("doc_id", "r.*")
    return found.select("doc_id", "rule_set", "kind", "term").unionByName(patterns)


RULE_VALUES_SQL = "(VALUES " + ", ".join(f"('{n}', '{k}', '{t}')" for n, k, t in rules.rows()) + ") AS r(rule_set, kind, term)"
RULE_ROWS_SQL = f"""tw AS (SELECT doc_id, lang, lower(text) AS t, {WORDS_OF_SQL} AS w FROM documents), tg AS (SELECT doc_id, lang, t, {GRAMS_SQL} AS g FROM tw),
rule_rows AS (SELECT doc_id, lang, rule_set, kind, term FROM tg JOIN {RULE_VALUES_SQL} ON rule_set <> 'noise' AND ((kind = 'pattern' AND regexp_matches(t, term)) OR (kind <> 'pattern' AND list_contains(g, term) AND term NOT IN {rules.NOISE!r})))"""


@query("WITH " + RULE_ROWS_SQL + " SELECT doc_id, rule_set, kind, term FROM rule_rows")
def jn_10(spark: SparkSession, sf: str) -> DataFrame:
    """Term containment: which rules' words, phrases and patterns a text holds."""
    return rule_rows(spark, read(spark, sf, "documents"))


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS agent FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END AS k FROM customer) LEFT JOIN nation ON k = n_nationkey")
def jn_11(spark: SparkSession, sf: str) -> DataFrame:
    """Dimension lookup; an unknown id gets a default name. The dimension is broadcast by its size alone."""
    users, names = read(spark, sf, "customer", "nation")
    users = users.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, -1).otherwise(F.col("c_nationkey")).alias("k"))
    return users.join(names, F.col("k") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("agent"))
