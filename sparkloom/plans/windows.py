"""Window functions and top-k over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import vectors
from ..operators.ranking import in_blocks, ranked, top
from ..operators.sections import sections
from ..operators.summaries import exact_percentiles
from ..sources.shared import written
from .base import query, read
from .filters import BM25_SQL, SEARCHED_SQL, asking, searched, text_hits
from .joins import LISTS_SQL, text_list


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'error') WHERE rn = 1")
def win_01(spark: SparkSession, sf: str) -> DataFrame:
    """Latest active ledger row per key."""
    e = read(spark, sf, "events").where("event_type <> 'error'")
    return top(e, ["user_id"], 1, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("SELECT conv_id, turn, CAST(CASE WHEN role = 'system' THEN 0 ELSE row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn) END AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS rn FROM conversations) WHERE (role = 'system' AND rn = 1) OR (role <> 'system' AND rn <= 4)")
def win_02(spark: SparkSession, sf: str) -> DataFrame:
    """The last four messages of a session, oldest first, its newest summary in front."""
    c = read(spark, sf, "conversations").withColumn("summary", F.col("role") == "system")
    last = ranked(c, ["conv_id", "summary"], F.desc("turn")).where("(summary and rank = 1) or (not summary and rank <= 4)")
    place = F.row_number().over(Window.partitionBy("conv_id", "summary").orderBy("turn"))
    return last.select("conv_id", "turn", F.when(F.col("summary"), 0).otherwise(place).cast("int").alias("place"))


@query("SELECT conv_id, turn, CASE WHEN r = 1 THEN least(n, 300) ELSE n END AS used FROM (SELECT conv_id, turn, least(length(text), 220) + 1 AS n, row_number() OVER w AS r, sum(least(length(text), 220) + 1) OVER w AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE r = 1 OR (r <= 6 AND total <= 300)")
def win_03(spark: SparkSession, sf: str) -> DataFrame:
    """Context by budget: newest first, six messages and 300 characters at most; the newest always stays."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    c = read(spark, sf, "conversations").select("conv_id", "turn", (F.least(F.length("text"), F.lit(220)) + 1).alias("n"))
    c = c.withColumns({"r": F.row_number().over(w), "total": F.sum("n").over(w)}).where("r = 1 or (r <= 6 and total <= 300)")
    return c.select("conv_id", "turn", F.when(F.col("r") == 1, F.least("n", F.lit(300))).otherwise(F.col("n")).alias("used"))


@query("SELECT conv_id, turn, n > 4 AND r <= n - 2 AS compacted FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)")
def win_04(spark: SparkSession, sf: str) -> DataFrame:
    """Compaction split: beyond four messages all but the newest two are compacted."""
    w = Window.partitionBy("conv_id")
    c = read(spark, sf, "conversations").withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy("turn"))})
    return c.select("conv_id", "turn", ((F.col("n") > 4) & (F.col("r") <= F.col("n") - 2)).alias("compacted"))


@query("SELECT event_id, CASE WHEN len(l) < 10 THEN 45.0 ELSE round(least(greatest(list_sort(l)[CAST(ceil(0.95 * len(l)) AS BIGINT)] * 1.3, 8), 45), 4) END AS timeout FROM (SELECT event_id, list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS l FROM events)")
def win_05(spark: SparkSession, sf: str) -> DataFrame:
    """Adaptive timeout: nearest-rank p95 of the last fifty latencies, by 1.3, from 8 to 45; 45 below ten samples."""
    events = in_blocks(read(spark, sf, "events").select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], back=49)
    w = Window.partitionBy("event_type", "_block").orderBy("ts", "event_id").rowsBetween(-49, 0)
    e = events.select("event_id", "_carried", F.collect_list("value").over(w).alias("l")).where("not _carried")
    p95 = F.element_at(F.array_sort("l"), F.ceil(F.lit(0.95) * F.size("l")).cast("int"))
    return e.select("event_id", F.when(F.size("l") < 10, 45.0).otherwise(F.round(F.least(F.greatest(p95 * 1.3, F.lit(8.0)), F.lit(45.0)), 4)).alias("timeout"))


@query("SELECT user_id, event_id, streak FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, g, event_type = 'error' ORDER BY ts, event_id) AS streak FROM (SELECT *, count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) WHERE event_type <> 'view') WHERE event_type = 'error' AND streak >= 3")
def win_06(spark: SparkSession, sf: str) -> DataFrame:
    """Failure streaks of three or more; a success resets, a view (a timeout) is ignored. Gaps and islands."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").where("event_type <> 'view'")
    e = e.withColumn("g", F.sum((F.col("event_type") != "error").cast("long")).over(w)).where("event_type = 'error'")
    streak = F.row_number().over(Window.partitionBy("user_id", "g").orderBy("ts", "event_id")).cast("long")
    return e.withColumn("streak", streak).where("streak >= 3").select("user_id", "event_id", "streak")


@query("WITH " + LISTS_SQL + " SELECT query_id, vec_id, rank FROM txt")
def win_07(spark: SparkSession, sf: str) -> DataFrame:
    """Place of each result in its list."""
    return text_list(spark, sf)


LINES_SQL = "l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


#: Lines with headings of four levels, others that only look like one, and fences with headings between them.
HEADED_LINE_SQL = "CASE i % 23 WHEN 1 THEN '# A' || i WHEN 3 THEN '## B  ' WHEN 5 THEN ' ### C' || i WHEN 8 THEN '####' WHEN 9 THEN '#### D' || i % 5 WHEN 11 THEN '##### five' WHEN 12 THEN '#none' WHEN 14 THEN '```py' WHEN 15 THEN '# code' WHEN 16 THEN '~~~' WHEN 18 THEN '```' WHEN 19 THEN '```x```' WHEN 20 THEN '## E' || i ELSE line END"
HEADED_SQL = LINES_SQL + f""", hl AS (SELECT doc_id, i, {HEADED_LINE_SQL} AS line FROM l), hn AS (SELECT *, i % 23 >= 14 AND i % 23 <= 18 AS code FROM hl),
  hv AS (SELECT *, CASE WHEN code THEN 0 ELSE length(regexp_extract(trim(line), '^(#{{1,4}})(\\s|$)', 1)) END AS level, trim(regexp_replace(trim(line), '^#+', '')) AS name FROM hn),
  hs AS (SELECT *, """ + ", ".join(f"last_value(CASE WHEN level BETWEEN 1 AND {k - 1} THEN '' WHEN level = {k} THEN name END IGNORE NULLS) OVER p AS h{k}" for k in range(1, 5)) + """, count(*) FILTER (WHERE level > 0) OVER p AS section FROM hv WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
  paths AS (SELECT doc_id, i, line, level, section, array_to_string(list_filter([h1, h2, h3, h4], lambda x: x <> ''), ' > ') AS path FROM hs)"""


def with_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the lines of HEADED_LINE_SQL."""

    def line(x: F.Column, k: F.Column) -> F.Column:
        n = (k + 1).cast("string")
        at = (k + 1) % 23
        numbered = lambda s, c=n: F.concat(F.lit(s), c)
        out = F.when(at == 1, numbered("# A")).when(at == 3, "## B  ").when(at == 5, numbered(" ### C")).when(at == 8, "####").when(at == 9, numbered("#### D", ((k + 1) % 5).cast("string"))).when(at == 11, "##### five").when(at == 12, "#none")
        return out.when(at == 14, "```py").when(at == 15, "# code").when(at == 16, "~~~").when(at == 18, "```").when(at == 19, "```x```").when(at == 20, numbered("## E")).otherwise(x)

    return read(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query("WITH " + HEADED_SQL + " SELECT doc_id, CAST(i AS INTEGER) AS i, path FROM paths WHERE level = 0")
def win_08(spark: SparkSession, sf: str) -> DataFrame:
    """Section path of each line: the open headings of four levels, deeper ones closed by a higher one; lines between fences
    are no headings (headings and fences are injected). In the row."""
    parts = with_headings(spark, sf).select("doc_id", F.explode(sections("text")).alias("s"))
    return parts.select("doc_id", F.array_join("s.path", " > ").alias("path"), "s.first", F.posexplode("s.lines").alias("p", "line")).select("doc_id", (F.col("first") + F.col("p") + 1).alias("i"), "path")


@query("WITH " + LINES_SQL + ", w AS (SELECT doc_id, i, line, list(line) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b, list(line) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS a FROM l) SELECT doc_id, CAST(i AS INTEGER) AS i, sha256(coalesce(array_to_string(b, chr(10)), '')) AS before, sha256(coalesce(array_to_string(a, chr(10)), '')) AS after FROM w WHERE regexp_matches(line, '\\d')")
def win_09(spark: SparkSession, sf: str) -> DataFrame:
    """Four lines before and after each line that holds a number."""
    lines = F.split("text", "\n")
    near = F.transform(lines, lambda x, p: F.struct((p + 1).alias("i"), x.rlike(r"\d").alias("hit"), F.slice(lines, F.greatest(p - 3, F.lit(1)), F.least(p, F.lit(4))).alias("b"), F.slice(lines, p + 2, F.lit(4)).alias("a")))
    found = read(spark, sf, "documents").select("doc_id", F.explode(F.filter(near, lambda x: x["hit"])).alias("x"))
    return found.select("doc_id", "x.i", F.sha2(F.array_join("x.b", "\n"), 256).alias("before"), F.sha2(F.array_join("x.a", "\n"), 256).alias("after"))


@query("WITH s AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents)) SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(length(s) - CASE WHEN regexp_matches(lead(s) OVER (PARTITION BY doc_id ORDER BY i), '(nicht|not|pas)') THEN 8 ELSE 0 END AS INTEGER) AS score FROM s")
def win_10(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence score with a penalty when the next sentence is negative."""
    parts = F.split("text", r"\. ")
    scored = F.transform(parts, lambda s, p: F.length(s) - F.when(F.get(parts, p + 1).rlike("(nicht|not|pas)"), 8).otherwise(0))
    return read(spark, sf, "documents").select("doc_id", F.posexplode(scored).alias("p", "score")).select("doc_id", (F.col("p") + 1).alias("i"), "score")


@query(
    """WITH d AS (SELECT label, vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]), 6) AS d FROM embeddings),
    q AS (SELECT label, quantile_cont(d, 0.75) + 0.5 * (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)) AS bar FROM d GROUP BY label)
    SELECT label, vec_id, CAST(sum(CASE WHEN d > bar + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS chunk FROM d JOIN q USING (label)"""
)
def win_11(spark: SparkSession, sf: str) -> DataFrame:
    """Semantic breakpoints: a distance above the quartile rule opens a new chunk (the factor is a parameter; 0.5 here)."""
    rows = in_blocks(read(spark, sf, "embeddings").select("label", "vec_id", "embedding"), ["label"], ["vec_id"], back=1)
    w = Window.partitionBy("label", "_block").orderBy("vec_id")
    d = rows.withColumn("before", F.lag("embedding").over(w)).where("not _carried").select("label", "_block", "vec_id", F.round(1 - vectors.cosine(F.col("embedding"), F.col("before")), 6).alias("d"))
    d = written(d, "distances")
    bars = exact_percentiles(d, ["label"], "d", (0.25, 0.75)).select("label", (F.col("p75") + 0.5 * (F.col("p75") - F.col("p25"))).alias("bar"))
    opens = d.join(bars, "label").withColumn("opens", F.when(F.col("d") > F.col("bar") + 1e-9, 1).otherwise(0))
    # The number of a chunk: openings in the blocks before (a row a block), and inside the block.
    blocks = opens.groupBy("label", "_block").agg(F.sum("opens").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = opens.join(blocks.select("label", "_block", earlier.alias("earlier")), ["label", "_block"])
    return joined.select("label", "vec_id", (F.col("earlier") + F.sum("opens").over(w)).alias("chunk"))


@query("WITH " + SEARCHED_SQL.format(k=10) + " SELECT query_id, vec_id, rank FROM hits WHERE query_id = 100")
def top_01(spark: SparkSession, sf: str) -> DataFrame:
    """Vector top-k of one query: a plain ordered limit, which Spark runs as one take-ordered step."""
    v = read(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = F.broadcast(v.where("vec_id = 100").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))  # one row
    best = v.join(asked).select("query_id", "vec_id", F.round(vectors.cosine(F.col("q"), F.col("embedding")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)
    return best.select("query_id", "vec_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank"))


@query("WITH " + BM25_SQL + " SELECT query_id, doc_id, rank FROM bm WHERE rank <= 8")
def top_02(spark: SparkSession, sf: str) -> DataFrame:
    """Text top-k: the eight best documents of each question by their rank score."""
    return text_hits(spark, sf, 8).select("query_id", "doc_id", "rank")


@query("WITH " + SEARCHED_SQL.format(k=8) + ", r AS (SELECT h.*, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE (vec_id * 37 % 101) / 100.0::DOUBLE END AS rerank FROM hits AS h) SELECT * FROM (SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rerank, -1e9) DESC, rank) AS INTEGER) AS place FROM r) WHERE place <= 5")
def top_03(spark: SparkSession, sf: str) -> DataFrame:
    """Rerank by supplied scores (a table); without a score the first order stays, behind the scored ones."""
    scores = read(spark, sf, "embeddings").where("vec_id % 3 <> 0").select("vec_id", ((F.col("vec_id") * 37 % 101) / 100.0).alias("rerank"))
    joined = searched(spark, sf).join(scores, "vec_id", "left")
    return top(joined, ["query_id"], 5, F.desc(F.coalesce("rerank", F.lit(-1e9))), F.asc("rank"), name="place").select("query_id", "vec_id", "place")


@query("WITH " + SEARCHED_SQL.format(k=1) + ", d AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS r FROM scored) SELECT query_id, vec_id, label, CAST(p AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS p FROM d WHERE r <= 3) WHERE p <= 6")
def top_04(spark: SparkSession, sf: str) -> DataFrame:
    """Top three per domain, then top six of those."""
    order = (F.desc("score"), F.asc("vec_id"))
    each = vectors.nearest(asking(spark, sf), read(spark, sf, "embeddings"), 3, within="label")
    return top(each, ["query_id"], 6, *order, name="place").select("query_id", "vec_id", "label", "place")


@query("WITH " + SEARCHED_SQL.format(k=8) + " SELECT query_id, arg_min(vec_id, struct_pack(a := CASE WHEN label = query_id // 100 % 10 THEN 0 ELSE 1 END, b := vec_id % 3, c := -score, d := vec_id)) AS best FROM hits GROUP BY query_id")
def top_05(spark: SparkSession, sf: str) -> DataFrame:
    """The first candidate by source, role, score."""
    labels = read(spark, sf, "embeddings").select("vec_id", "label")
    key = F.struct(F.when(F.col("label") == F.floor(F.col("query_id") / 100) % 10, 0).otherwise(1), F.col("vec_id") % 3, -F.col("score"), "vec_id")
    return searched(spark, sf).join(labels, "vec_id").groupBy("query_id").agg(F.min_by("vec_id", key).alias("best"))


@query("""SELECT o_custkey, o_orderkey AS session, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place,
  o_orderkey = first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, o_orderdate DESC, o_orderkey DESC) AS active FROM orders QUALIFY place <= 5 OR active""")
def top_06(spark: SparkSession, sf: str) -> DataFrame:
    """Recency list: the five newest sessions (orders) of each thread (customer), newest first, and which session is active: the
    newest open one, else the newest. An active one further back is listed too."""
    o = read(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("session"), "o_orderdate", (F.col("o_orderstatus") == "O").alias("open"))
    newest = ranked(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("session"), name="place")
    active = o.groupBy("o_custkey").agg(F.max_by("session", F.struct("open", "o_orderdate", "session")).alias("chosen"))
    listed = newest.join(active, "o_custkey").withColumn("active", F.col("session") == F.col("chosen"))
    return listed.where("place <= 5 or active").select("o_custkey", "session", "place", "active")
