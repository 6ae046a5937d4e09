"""Classification and routing as table jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import rules
from ..operators.ranking import top
from ..sources.shared import written
from .aggregates import TERM_STATS_SQL, term_stats
from .base import query, read
from .joins import GRAMS_SQL, WORDS_OF_SQL



def signal_sql(name: str) -> str:
    """Whether a rule set speaks, over g (grams) and t (text in lower case)."""
    kinds = rules.RULES[name]
    terms = kinds.get("word", ()) + kinds.get("phrase", ())
    tests = [f"list_has_any(g, {list(terms)!r})"] if terms else []
    return "(" + " OR ".join(tests + [f"regexp_matches(t, '{p}')" for p in kinds.get("pattern", ())]) + ")"


def weight_sql(found: str, agent: int) -> str:
    strong = ", ".join(f"'{t}'" for t in rules.STRONG_HINTS[agent])
    return f"CAST(coalesce(list_sum(list_transform({found}, lambda x: CASE WHEN x IN ({strong}) THEN 3 WHEN x IN {rules.NOISE!r} THEN 0 WHEN contains(x, ' ') OR length(x) >= {rules.LONG} THEN 2 ELSE 1 END)), 0) AS BIGINT)"


def signals_sql(table: str, key: str) -> str:
    kw = f"list_filter({list(rules.KEYWORDS[1])!r}, lambda x: list_contains(g, x) AND x NOT IN {rules.NOISE!r})"
    return f"""sw AS (SELECT {key}, lower(text) AS t, {WORDS_OF_SQL} AS w FROM {table}), sg AS (SELECT {key}, t, w, {GRAMS_SQL} AS g FROM sw),
signals AS (SELECT {key}, {", ".join(f"{signal_sql(n)} AS {n}" for n in rules.RULES)}, len(w) AS n_words, regexp_matches(t, '[\\d?]') AS objective, len({kw}) AS hits, {weight_sql(kw, 1)} AS weight FROM sg)"""


ROUTES_SQL = signals_sql("documents", "doc_id") + """, routes AS (SELECT *, CASE WHEN n_words = 0 OR (greeting AND n_words <= 6) THEN [] WHEN legal THEN [3]
  WHEN (normative OR labelling OR strong) AND NOT special AND NOT quality THEN [3] WHEN normative OR labelling OR strong OR special OR fermented THEN [1, 3]
  WHEN hits >= 2 OR weight >= 3 OR (weight >= 2 AND hits >= 1) OR domain THEN [1, 3] END AS ids FROM signals),
sure AS (SELECT *, CASE WHEN len(ids) = 0 THEN 0.98 WHEN strong OR special THEN 0.86 WHEN list_contains(ids, 1) THEN 0.82 WHEN domain THEN 0.70 ELSE 0.60 END::DOUBLE AS estimate, (doc_id % 100) / 100.0::DOUBLE AS raw FROM routes),
floored AS (SELECT *, greatest(raw, CASE WHEN strong AND list_contains(ids, 3) THEN 0.84::DOUBLE ELSE 0 END, CASE WHEN special AND list_contains(ids, 1) THEN 0.82::DOUBLE ELSE 0 END) AS f FROM sure),
routed AS (SELECT *, CASE WHEN len(ids) = 0 THEN raw WHEN NOT coalesce(list_contains(ids, 1), false) AND domain AND objective THEN least(f, 0.69::DOUBLE) ELSE f END AS recalibrated FROM floored)"""


def routed(spark: SparkSession, sf: str) -> DataFrame:
    """Signals, route, estimated confidence, and a raw confidence (from outside; here of the id) recalibrated. One pass over
    the texts without a shuffle."""
    s = rules.signals(read(spark, sf, "documents"), "doc_id").withColumn("ids", rules.route())
    ids = F.coalesce("ids", F.array(F.lit(0)))  # no rule held: neither empty nor any agent
    return s.withColumn("estimate", rules.estimate(ids)).withColumn("recalibrated", rules.recalibrated(F.col("doc_id") % 100 / 100.0, ids))


@query("WITH " + signals_sql("documents", "doc_id") + " SELECT doc_id, " + ", ".join(rules.RULES) + " FROM signals")
def cls_01(spark: SparkSession, sf: str) -> DataFrame:
    """Domain signal flags of the rule sets."""
    return rules.signals(read(spark, sf, "documents"), "doc_id").select("doc_id", *rules.RULES)


@query("WITH " + ROUTES_SQL + " SELECT doc_id, array_to_string(ids, ',') AS route FROM routed")
def cls_02(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered rule cascade to a route; null without a match."""
    return routed(spark, sf).select("doc_id", F.array_join("ids", ",").alias("route"))


@query("WITH " + signals_sql("documents", "doc_id") + ", kw AS (" + " UNION ALL ".join(f"SELECT doc_id, {a} AS agent, list_filter({list(k)!r}, lambda x: list_contains(g, x) AND x NOT IN {rules.NOISE!r}) AS found FROM sg" for a, k in rules.KEYWORDS.items()) + "), s AS (SELECT doc_id, agent, len(found) AS hits, CASE agent " + " ".join(f"WHEN {a} THEN {weight_sql('found', a)}" for a in rules.KEYWORDS) + " END AS weight FROM kw) SELECT doc_id, agent, CAST(hits AS INTEGER) AS hits, CAST(weight AS INTEGER) AS weight FROM s WHERE hits >= 2 OR weight >= 3 OR (weight >= 2 AND hits >= 1)")
def cls_03(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted keyword score of each agent; matched rows."""
    seen = read(spark, sf, "documents").select("doc_id", rules.terms_in("text").alias("g"))
    each = [F.struct(F.lit(a).alias("agent"), F.filter(rules.held(F.col("g"), k), lambda x: ~x.isin(*rules.NOISE)).alias("found")) for a, k in rules.KEYWORDS.items()]
    kw = seen.select("doc_id", F.explode(F.array(*each)).alias("k")).select("doc_id", "k.agent", "k.found")
    weight = F.coalesce(*[F.when(F.col("agent") == a, rules.weight_of(F.col("found"), a)) for a in rules.KEYWORDS])
    s = kw.select("doc_id", "agent", F.size("found").alias("hits"), weight.alias("weight"))
    return s.where(rules.matched(F.col("hits"), F.col("weight")))


@query("WITH " + ROUTES_SQL + " SELECT doc_id, round(estimate, 4) AS estimate, round(recalibrated, 4) AS recalibrated FROM routed")
def cls_04(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of a route: stepped estimate, and a given confidence held to floors and ceilings."""
    return routed(spark, sf).select("doc_id", F.round("estimate", 4).alias("estimate"), F.round("recalibrated", 4).alias("recalibrated"))


@query("WITH " + ROUTES_SQL + """, k AS (SELECT doc_id, strong, recalibrated, list_filter(coalesce(ids, [1]), lambda x: x <> 4) AS kept FROM routed),
  g AS (SELECT *, CASE WHEN strong AND len(kept) > 0 AND NOT list_contains(kept, 3) THEN list_append(kept, 3) ELSE kept END AS guarded FROM k),
  p AS (SELECT doc_id, list_concat(guarded, list_filter([3, 5], lambda x: NOT list_contains(guarded, x)))[1:CASE WHEN recalibrated >= 0.86 THEN 2 WHEN recalibrated >= 0.55 THEN 3 ELSE 4 END] AS p FROM g)
  SELECT doc_id, array_to_string(p, ',') AS plan, coalesce(list_filter(p, lambda x: x <> 3)[1], p[1]) AS primary_id FROM p""")
def cls_05(spark: SparkSession, sf: str) -> DataFrame:
    """Execution plan: route without barred agents, the guard of strong signs, alternatives, cut by the bucket; the first
    specialist is the primary one."""
    bucket = F.when(F.col("recalibrated") >= 0.86, "high").when(F.col("recalibrated") >= 0.55, "medium").otherwise("low")
    p = routed(spark, sf).select("doc_id", rules.plan(F.coalesce("ids", F.array(F.lit(1))), bucket, barred=(4,), alternatives=(3, 5)).alias("p"))
    primary = F.coalesce(F.get(F.filter("p", lambda x: x != 3), F.lit(0)), F.get("p", F.lit(0)))
    return p.select("doc_id", F.array_join("p", ",").alias("plan"), primary.alias("primary_id"))


@query("WITH " + signals_sql("benchmark", "item_id") + """, i AS (SELECT item_id, CASE WHEN greeting AND n_words <= 6 THEN {'domain': 'greeting', 'tables': CAST([] AS VARCHAR[]), 'needs_rules': false, 'type': 'general'}
  WHEN quality AND defect THEN {'domain': 'process', 'tables': ['quality', 'rules'], 'needs_rules': true, 'type': 'general'} WHEN legal THEN {'domain': 'legal', 'tables': ['rules'], 'needs_rules': true, 'type': 'regulatory'}
  WHEN (strong OR normative OR labelling) AND special THEN {'domain': 'special_rules', 'tables': ['special', 'rules'], 'needs_rules': true, 'type': 'regulatory'} WHEN strong OR normative OR labelling THEN {'domain': 'rules', 'tables': ['rules'], 'needs_rules': true, 'type': 'regulatory'}
  WHEN fermented AND NOT special THEN {'domain': 'fermented', 'tables': ['fermented'], 'needs_rules': false, 'type': 'general'} WHEN formulation AND NOT special AND NOT quality THEN {'domain': 'formulation', 'tables': ['formulation'], 'needs_rules': false, 'type': 'general'}
  ELSE {'domain': 'fallback', 'tables': ['special', 'rules'], 'needs_rules': false, 'type': 'general'} END AS x FROM signals)
  SELECT item_id, x.domain AS domain, x.needs_rules AS needs_rules, x.type AS question_type, unnest(x.tables) AS search_table FROM i""")
def cls_06(spark: SparkSession, sf: str) -> DataFrame:
    """Query intent to the tables to search, one row per table; two tables where nothing is clear."""
    x = rules.signals(read(spark, sf, "benchmark"), "item_id").select("item_id", rules.intent().alias("x"))
    return x.select("item_id", "x.domain", "x.needs_rules", F.col("x.type").alias("question_type"), F.explode("x.tables").alias("search_table"))


HINTS_SQL = TERM_STATS_SQL + ", hints AS (SELECT term, agent, kind, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY agent, kind ORDER BY score DESC, precision DESC, support DESC, term) AS INTEGER) AS place FROM (SELECT *, CASE WHEN support >= 4 AND groups >= 2 AND precision >= 0.8 THEN 'strong' WHEN support >= 2 AND precision >= 0.65 THEN 'medium' END AS kind FROM stats)) WHERE kind IS NOT NULL AND place <= CASE WHEN kind = 'strong' THEN 45 ELSE 60 END)"


def hints(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when((F.col("support") >= 4) & (F.col("groups") >= 2) & (F.col("precision") >= 0.8), "strong").when((F.col("support") >= 2) & (F.col("precision") >= 0.65), "medium")
    classed = term_stats(spark, sf).withColumn("kind", kind).where("kind is not null")
    ranked = top(classed, ["agent", "kind"], 60, F.desc("score"), F.desc("precision"), F.desc("support"), F.asc("term"), name="place")
    return ranked.where("kind = 'medium' or place <= 45").select("term", "agent", "kind", "place")


@query("WITH " + HINTS_SQL + " SELECT * FROM hints")
def cls_07(spark: SparkSession, sf: str) -> DataFrame:
    """Term mining for routing hints: strong and medium terms per agent."""
    return hints(spark, sf)


#: Signs of dependence in the languages of the texts.
RECAP = r"(^|[^\p{L}])(in sum|as said|en resumen|en somme)([^\p{L}]|$)"
COMPARISON = r"(^|[^\p{L}])(than|als)([^\p{L}]|$)"
FOLLOWUP = r"^(and|und|et|y)([^\p{L}]|$)"
ANAPHORA = r"(^|[^\p{L}])(it|this|das|ce|eso)([^\p{L}]|$)"
DEEPENING = r"(^|[^\p{L}])(more|mehr|plus|que)([^\p{L}]|$)"
TOPIC = r"(^|[^\p{L}])(the|les|der|los)([^\p{L}]|$)"


@query(f"""WITH c AS (SELECT conv_id, turn, lower(trim(text)) AS t, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS n,
  coalesce(bool_or(trim(text) <> '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS known FROM conversations),
  r AS (SELECT *, CASE WHEN t = '' THEN 'empty/empty message' WHEN regexp_matches(t, '{RECAP}') THEN 'recap/reference to what was said' WHEN regexp_matches(t, '{COMPARISON}') THEN 'comparison/comparing word'
  WHEN regexp_matches(t, '{FOLLOWUP}') AND n <= 12 THEN 'followup/short opening' WHEN regexp_matches(t, '{ANAPHORA}') AND n <= 24 THEN 'followup/pronoun'
  WHEN regexp_matches(t, '{DEEPENING}') AND (known OR regexp_matches(t, '{ANAPHORA}')) THEN 'deepening/with context' WHEN regexp_matches(t, '{DEEPENING}') AND length(t) <= 220 AND NOT regexp_matches(t, '{TOPIC}') THEN 'deepening/without a topic'
  ELSE 'standalone/own topic' END AS why FROM c) SELECT conv_id, turn, string_split(why, '/')[1] AS intent, string_split(why, '/')[2] AS reason, string_split(why, '/')[1] NOT IN ('empty', 'standalone') AS depends FROM r""")
def cls_08(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a turn depends on those before it, how, and by which sign; a standalone turn opens a topic of its own."""
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.bool_or(F.trim("text") != "").over(earlier), F.lit(False))
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.lower(F.trim("text")).alias("t"), F.size(F.split(text.collapse("text"), " ")).alias("n"), known.alias("known"))

    def sign(pattern: str) -> F.Column:
        return F.col("t").rlike(pattern)

    why = (
        F.when(F.col("t") == "", "empty/empty message")
        .when(sign(RECAP), "recap/reference to what was said")
        .when(sign(COMPARISON), "comparison/comparing word")
        .when(sign(FOLLOWUP) & (F.col("n") <= 12), "followup/short opening")
        .when(sign(ANAPHORA) & (F.col("n") <= 24), "followup/pronoun")
        .when(sign(DEEPENING) & (F.col("known") | sign(ANAPHORA)), "deepening/with context")
        .when(sign(DEEPENING) & (F.length("t") <= 220) & ~sign(TOPIC), "deepening/without a topic")
        .otherwise("standalone/own topic")
    )
    part = F.split(why, "/")
    return c.select("conv_id", "turn", part[0].alias("intent"), part[1].alias("reason"), (~part[0].isin("empty", "standalone")).alias("depends"))


@query("SELECT conv_id, turn, len(w) < 8 OR len(list_filter(w, lambda x: x IN ('it', 'this', 'that', 'das', 'ce', 'eso'))) > 0 AS rewrite, coalesce(prev, '') LIKE '%?' AS after_question FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w, lag(trim(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)")
def cls_09(spark: SparkSession, sf: str) -> DataFrame:
    """Need for a rewrite with context, and whether the turn before was a question."""
    w = text.words(F.lower("text"), 1)
    prev = F.lag(F.trim("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    c = read(spark, sf, "conversations").select("conv_id", "turn", w.alias("w"), prev.alias("prev"))
    refers = F.arrays_overlap("w", F.array(*map(F.lit, ("it", "this", "that", "das", "ce", "eso"))))
    return c.select("conv_id", "turn", ((F.size("w") < 8) | refers).alias("rewrite"), F.coalesce(F.col("prev").endswith("?"), F.lit(False)).alias("after_question"))


LAST_TURNS = 3  # as the reference asks for; a blank message is no turn
CAPS = {"user": ("User: ", 220), "assistant": ("Answer: ", 160), "summary": ("Summary: ", 280), "system": ("System: ", 400)}  # fixed values


@query("WITH u AS (SELECT *, count(*) FILTER (WHERE role = 'user' AND regexp_matches(text, '[^\\x20\\x09-\\x0D]')) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, role = 'user' AND regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS asks, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, string_agg(CASE role " + " ".join(f"WHEN '{r}' THEN '{label}' || substr(text, 1, {n})" for r, (label, n) in CAPS.items()) + f" END, chr(10) ORDER BY turn) FILTER (WHERE back < {LAST_TURNS} OR (back = {LAST_TURNS} AND asks)) AS history FROM u GROUP BY conv_id")
def cls_10(spark: SparkSession, sf: str) -> DataFrame:
    """History as labelled lines, each cut by its role, from the user's third last message on. In the row of the
    conversation: its turns are gathered, then what is before the wanted turns is cut off."""
    line = F.lit(None).cast("string")
    for role, (label, most) in CAPS.items():
        line = F.when(F.col("role") == role, F.concat(F.lit(label), F.substring("text", 1, most))).otherwise(line)
    asks = (F.col("role") == "user") & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    said = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", line.alias("s"), asks.alias("asks")))).alias("l"))
    asked = F.filter("l", lambda x: x["asks"])
    since = F.when(F.size(asked) >= LAST_TURNS, F.element_at(asked, -LAST_TURNS)["turn"]).otherwise(F.lit(-(1 << 62)))
    return said.select("conv_id", "l", since.alias("since")).select("conv_id", F.nullif(F.array_join(F.transform(F.filter("l", lambda x: x["turn"] >= F.col("since")), lambda x: x["s"]), "\n"), F.lit("")).alias("history"))


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN toxic = 1 THEN 0.0 ELSE 0.5 END AS score, CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' WHEN toxic = 1 THEN 'rejected' ELSE 'review' END AS status, CASE WHEN NOT (quality = 1 AND toxic = 0) THEN coalesce(CASE WHEN toxic = 1 THEN 'noise' END, 'incomplete') END AS error_category FROM labels")
def cls_11(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation rows: score and status from a verdict, no error category when correct."""
    good, bad = (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("toxic") == 1
    return read(spark, sf, "labels").select("doc_id", F.when(good, 1.0).when(bad, 0.0).otherwise(0.5).alias("score"), F.when(good, "approved").when(bad, "rejected").otherwise("review").alias("status"), F.when(~good, F.coalesce(F.when(bad, "noise"), F.lit("incomplete"))).alias("error_category"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) % 7))), ',') AS agents, CASE WHEN bool_or(event_type = 'purchase') THEN 'rag' WHEN bool_or(event_type = 'click') THEN 'tool' ELSE 'model' END AS source FROM events GROUP BY user_id")
def cls_12(spark: SparkSession, sf: str) -> DataFrame:
    """Agents named in a trace, and the class of the answer's source."""
    agent = F.regexp_extract("props", r"(\d+)", 1).cast("int") % 7
    source = F.when(F.bool_or(F.col("event_type") == "purchase"), "rag").when(F.bool_or(F.col("event_type") == "click"), "tool").otherwise("model")
    return read(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(agent)).cast("array<string>"), ",").alias("agents"), source.alias("source"))


#: What the filter knows: defaults that always stay, noise, words that say little alone, and the domain's vocabulary.
DEFAULT_HINTS = (("the", "en"), ("und", "de"))
NOISE_HINTS, NOISE_TOKENS, LOW_PRECISION_HINTS = ("that with",), ("that", "with", "sich", "para"), ("the and",)
PAIRED_SQL = HINTS_SQL + ", pairs AS (SELECT term, agent FROM hints UNION SELECT a.term || ' ' || b.term, a.agent FROM hints AS a JOIN hints AS b ON a.agent = b.agent AND a.kind = b.kind AND b.place = a.place + 1), vocabulary AS (SELECT DISTINCT agent, term AS word FROM hints WHERE kind = 'strong' AND place % 2 = 1)"


@query("WITH " + PAIRED_SQL + f""" SELECT term, agent FROM pairs AS p WHERE contains(term, ' ') AND len(string_split(term, ' ')) <= 2 AND term NOT IN ('{NOISE_HINTS[0]}', '{LOW_PRECISION_HINTS[0]}') AND NOT regexp_matches(term, '\\d')
  AND NOT list_has_any(string_split(term, ' '), {list(NOISE_TOKENS)!r}) AND list_has_any(list_filter(string_split(term, ' '), lambda w: length(w) >= 4), (SELECT list(word) FROM vocabulary AS v WHERE v.agent = p.agent)) UNION SELECT term, agent FROM (VALUES {', '.join(map(repr, DEFAULT_HINTS))}) AS d(term, agent)""")
def cls_13(spark: SparkSession, sf: str) -> DataFrame:
    """Hint filter: out go noise terms, terms with digits or noise words, single words, terms of more than two words, terms
    that say little, and those without a word of the domain's vocabulary; the defaults always stay. Terms are the mined
    hints and pairs of neighbours in their lists; every second strong hint is the vocabulary."""
    mined = written(hints(spark, sf), "hints")
    after = mined.select("agent", "kind", (F.col("place") - 1).alias("place"), F.col("term").alias("next"))
    pairs = mined.join(after, ["agent", "kind", "place"]).select(F.concat_ws(" ", "term", "next").alias("term"), "agent")
    vocabulary = mined.where("kind = 'strong' and place % 2 = 1").select("agent", F.col("term").alias("word")).distinct()
    words = F.split("term", " ")
    terms = mined.select("term", "agent").union(pairs).distinct().where((F.size(words) == 2) & ~F.col("term").isin(*NOISE_HINTS, *LOW_PRECISION_HINTS) & ~F.col("term").rlike(r"\d"))
    terms = terms.where(~F.arrays_overlap(words, F.array(*map(F.lit, NOISE_TOKENS))))
    known = terms.select("term", "agent", F.explode(F.filter(words, lambda w: F.length(w) >= 4)).alias("word")).join(vocabulary, ["agent", "word"], "left_semi")
    return known.select("term", "agent").union(spark.createDataFrame(DEFAULT_HINTS, "term string, agent string")).distinct()
