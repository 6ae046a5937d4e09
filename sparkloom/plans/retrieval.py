"""Composed retrieval over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import vectors
from ..operators import evidence as reducer
from ..operators.cover import cover_density
from ..operators.ranking import boosted, fuse, top
from ..operators.search import search, two_pass
from .base import query, read
from .filters import BM25_SQL, FOLDED_WORDS_SQL, HOST_SQL, KEYWORDS_SQL, SEARCHED_SQL, asking, searched, text_hits
from .joins import LISTS_SQL, chunks, lists_sql, questions, text_list
from .scalars import HTML_SQL


@query("WITH " + LISTS_SQL + ", f AS (SELECT query_id, vec_id, round(sum(s), 12) AS score FROM (SELECT query_id, vec_id, 1.5::DOUBLE / (60 + rank) AS s FROM hits UNION ALL SELECT query_id, vec_id, 1.0::DOUBLE / (60 + rank) FROM txt) GROUP BY query_id, vec_id) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM f) WHERE rank <= 8")
def ret_01(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search: vector and BM25 lists at three times k, fused with weights 1.5 and 1."""
    return search(questions(spark, sf), chunks(spark, sf), "hybrid", 8).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("WITH " + LISTS_SQL + ", again AS (SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vec_id * 37 % 101 DESC, vec_id) AS INTEGER) AS rank FROM hits WHERE vec_id % 3 <> 0), f AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, vec_id, rank FROM hits UNION ALL SELECT query_id, vec_id, rank FROM txt UNION ALL SELECT query_id, vec_id, rank FROM again) GROUP BY query_id, vec_id) SELECT query_id, vec_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM f) WHERE rank <= 10")
def ret_02(spark: SparkSession, sf: str) -> DataFrame:
    """Unweighted fusion of three lists: by vector, by text, and by a relevance score from outside (as in top_03), which some
    rows lack."""
    hits = searched(spark, sf, 24)
    scored = hits.where("vec_id % 3 <> 0").withColumn("relevance", F.col("vec_id") * 37 % 101)
    again = scored.select("query_id", "vec_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "vec_id")).alias("rank"))
    fused = fuse({"vector": (hits, 1.0), "text": (text_list(spark, sf), 1.0), "relevance": (again, 1.0)}, ["query_id"], "vec_id").withColumn("score", F.round("score", 12))
    return top(fused, ["query_id"], 10, F.desc("score"), F.asc("vec_id")).select("query_id", "vec_id", "rank")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) END, CASE WHEN doc_id % 3 = 1 THEN source END, lang) || ':' || md5(text) AS item_key FROM documents")
def ret_03(spark: SparkSession, sf: str) -> DataFrame:
    """Item key: the first id there is, and the hash of the content."""
    first = F.coalesce(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 3 == 1, F.col("source")), F.col("lang"))
    return read(spark, sf, "documents").select("doc_id", F.concat_ws(":", first, F.md5("text")).alias("item_key"))


GLOSSARY = ("term:", "substitution:", "keywords:")  # what marks an entry of a glossary, and a row that only lists keywords
HAY_SQL = "lower(strip_accents(CASE WHEN doc_id % 5 = 0 THEN 'term: ' || string_split(text, ' ')[1] || ' substitution: ' WHEN doc_id % 11 = 0 THEN 'keywords: ' ELSE '' END || text || ' ' || source))"


@query(
    "WITH " + BM25_SQL + f""", k AS (SELECT item_id AS query_id, item_id % 2 = 0 AS definition, {KEYWORDS_SQL.format("strip_accents(text)")} AS kw FROM benchmark),
  c AS (SELECT query_id, doc_id, bm.rank, kw, definition, {HAY_SQL} AS hay FROM bm JOIN documents USING (doc_id) JOIN k USING (query_id) WHERE bm.rank <= 24),
  s AS (SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rank) + 0.01::DOUBLE * len(list_filter(kw, lambda x: contains(hay, x))) + CASE WHEN definition THEN
    CASE WHEN contains(hay, 'term:') AND contains(hay, 'substitution:') THEN 0.2::DOUBLE ELSE 0 END + 0.15::DOUBLE * len(list_filter(kw, lambda x: contains(hay, 'term: ' || x))) - CASE WHEN contains(hay, 'keywords:') THEN 0.05::DOUBLE ELSE 0 END ELSE 0 END, 6) AS score FROM c)
  SELECT query_id AS item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 8"""
)
def ret_04(spark: SparkSession, sf: str) -> DataFrame:
    """Search results ordered anew by keywords found in text and source, and, where a definition is asked for (every second
    question here), by being an entry of a glossary. Entries are injected: the texts hold none."""
    docs, asked = read(spark, sf, "documents", "benchmark")
    lead = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("term: "), F.split("text", " ")[0], F.lit(" substitution: "))).when(F.col("doc_id") % 11 == 0, "keywords: ").otherwise("")
    hay = docs.select("doc_id", F.lower(text.unmarked(F.concat(lead, "text", F.lit(" "), "source"))).alias("hay"))
    asked = asked.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 2 == 0).alias("definition"), text.keywords(text.unmarked("text")).alias("kw"))
    found = text_hits(spark, sf, 24).select("query_id", "doc_id", "rank").join(hay, "doc_id").join(asked, "query_id")
    score = boosted(1.0 / (60 + F.col("rank")), F.col("kw"), F.col("hay"), definition=F.col("definition"), marks=GLOSSARY)
    scored = found.select(F.col("query_id").alias("item_id"), "doc_id", F.round(score, 6).alias("score"))
    return top(scored, ["item_id"], 8, F.desc("score"), F.asc("doc_id")).select("item_id", "doc_id", "score")


@query("WITH " + BM25_SQL + " SELECT query_id, doc_id, round(score + 1e-7, 3) AS score, matched, rank FROM bm WHERE rank <= 20")
def ret_05(spark: SparkSession, sf: str) -> DataFrame:
    """Text relevance by BM25: the twenty best documents of every question."""
    return text_hits(spark, sf, 20).withColumn("score", F.round(F.col("score") + 1e-7, 3))


COVER_SQL = "dw AS (SELECT doc_id, " + FOLDED_WORDS_SQL.format("text", 1) + """ AS w FROM documents), q AS (SELECT item_id AS query_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:3] AS terms FROM (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]{4,}') AS l FROM benchmark)),
  p AS (SELECT query_id, doc_id, len(terms) AS n, w, terms FROM q JOIN dw ON len(terms) > 0 AND list_has_all(w, terms)),
  o AS (SELECT query_id, doc_id, n, i, list_position(terms, x) AS t FROM (SELECT query_id, doc_id, n, terms, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM p) WHERE list_contains(terms, x)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY i) AS j FROM o),
  m AS (SELECT *, max(CASE WHEN t = 1 THEN j END) OVER s AS a, CASE WHEN n < 2 THEN j ELSE max(CASE WHEN t = 2 THEN j END) OVER s END AS b, CASE WHEN n < 3 THEN j ELSE max(CASE WHEN t = 3 THEN j END) OVER s END AS c FROM r WINDOW s AS (PARTITION BY query_id, doc_id ORDER BY i)),
  l AS (SELECT *, least(a, b, c) AS low FROM m WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
  f AS (SELECT *, lag(low, 1, 0) OVER (PARTITION BY query_id, doc_id ORDER BY i) AS before FROM l),
  g AS (SELECT f.query_id, f.doc_id, f.i - r.i - (f.j - r.j) AS noise FROM f JOIN r ON r.query_id = f.query_id AND r.doc_id = f.doc_id AND r.j = f.low WHERE f.low > f.before)"""


@query("WITH " + COVER_SQL + " SELECT query_id, doc_id, round(sum(0.1::DOUBLE / (1 + noise)) + 1e-9, 5) AS score, CAST(count(*) AS INTEGER) AS covers FROM g GROUP BY query_id, doc_id")
def ret_05_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Text relevance by cover density, beside BM25: documents that hold the first three words of a question, by how close
    they stand."""
    docs, asked = read(spark, sf, "documents", "benchmark")
    queries = asked.select(F.col("item_id").alias("query_id"), F.slice(F.array_distinct(text.folded_words("text", 4)), 1, 3).alias("terms"))
    return cover_density(queries, docs).withColumn("score", F.round(F.col("score") + 1e-9, 5))


@query("WITH " + lists_sql(60) + """, first AS (SELECT * FROM hits WHERE rank <= 8), weak AS (SELECT query_id FROM first GROUP BY query_id HAVING count(*) < 3 OR coalesce(max(score) FILTER (WHERE vec_id <> query_id), -1) < 0.42),
  wide AS (SELECT query_id, vec_id, round(sum(s), 12) AS s FROM (SELECT query_id, vec_id, 1.5::DOUBLE / (60 + rank) AS s FROM hits UNION ALL SELECT query_id, vec_id, 1.0::DOUBLE / (60 + rank) FROM txt) SEMI JOIN weak USING (query_id) GROUP BY query_id, vec_id),
  again AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM wide), lists AS (SELECT query_id, vec_id, rank FROM first UNION ALL SELECT query_id, vec_id, rank FROM again WHERE rank <= 20),
  f AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM lists GROUP BY query_id, vec_id)
  SELECT query_id, vec_id, rank, query_id IN (SELECT query_id FROM weak) AS second FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM f) WHERE rank <= 8""")
def ret_06(spark: SparkSession, sf: str) -> DataFrame:
    """Two-pass search: queries with weak first results are searched again more widely by vector and text, and both lists
    fused."""
    return two_pass(questions(spark, sf), chunks(spark, sf), k=8, weak_below=0.42)


@query("WITH " + SEARCHED_SQL.format(k=16) + ", f AS (SELECT query_id // 400 AS asked, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM hits GROUP BY asked, vec_id) SELECT asked, vec_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM f) WHERE rank <= 8")
def ret_07(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-query search: four variants of each query, searched apart and fused."""
    hits = searched(spark, sf, 16).withColumn("asked", F.floor(F.col("query_id") / 400))
    fused = hits.groupBy("asked", "vec_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 12).alias("score"))
    return top(fused, ["asked"], 8, F.desc("score"), F.asc("vec_id")).select("asked", "vec_id", "rank")


@query("WITH v AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS f FROM conversations), d AS (SELECT conv_id, f, min(turn) AS turn FROM v WHERE f <> '' GROUP BY conv_id, f) SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM d) WHERE r <= 4")
def ret_08(spark: SparkSession, sf: str) -> DataFrame:
    """Variant clean-up: distinct by folded text, the base first, four at most."""
    v = read(spark, sf, "conversations").select("conv_id", "turn", F.lower(text.collapse("text")).alias("f")).where("f <> ''")
    return top(v.groupBy("conv_id", "f").agg(F.min("turn").alias("turn")), ["conv_id"], 4, F.asc("turn")).select("conv_id", "turn")


@query("WITH " + SEARCHED_SQL.format(k=1) + ", d AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS r FROM scored), f AS (SELECT query_id, vec_id, round(1.0::DOUBLE / (60 + r), 12) AS s, score FROM d WHERE r <= 3) SELECT query_id, vec_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, score DESC, vec_id) AS INTEGER) AS rank FROM f) WHERE rank <= 6")
def ret_09(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-domain search: three per domain, fused by rank, six in the end."""
    each = vectors.nearest(asking(spark, sf), read(spark, sf, "embeddings"), 3, within="label").withColumn("s", F.round(1.0 / (60 + F.col("rank")), 12)).drop("rank")
    return top(each, ["query_id"], 6, F.desc("s"), F.desc("score"), F.asc("vec_id")).select("query_id", "vec_id", "rank")


@query("WITH " + BM25_SQL + f", c AS (SELECT query_id, string_agg(lower(text), ' ') AS hay FROM bm JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id) SELECT query_id, len(list_filter({KEYWORDS_SQL.format('text')}, lambda w: NOT contains(hay, w))) = 0 AS hit FROM c JOIN benchmark ON item_id = query_id")
def ret_10(spark: SparkSession, sf: str) -> DataFrame:
    """Hit@5: all keywords of a question inside the texts of its five best documents, joined."""
    best = text_hits(spark, sf, 5)
    hay = best.join(read(spark, sf, "documents").select("doc_id", "text"), "doc_id").groupBy("query_id").agg(F.array_join(F.collect_list(F.lower("text")), " ").alias("hay"))
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.keywords("text").alias("w"))
    return hay.join(asked, "query_id").select("query_id", F.forall("w", lambda x: F.contains(F.col("hay"), x)).alias("hit"))


@query("WITH " + SEARCHED_SQL.format(k=5) + " SELECT query_id, string_agg('[' || rank || '] row ' || vec_id || ' of ' || label, chr(10) ORDER BY rank) AS block FROM hits GROUP BY query_id")
def ret_11(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence block: five numbered rows."""
    rows = searched(spark, sf, 5).join(read(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    line = F.format_string("[%d] row %d of %d", "rank", "vec_id", "label")
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("s")))), lambda x: x["s"]), "\n").alias("block"))


NEGATIVE = "(^| )(nicht|not|pas|no) "  # a sentence that calls something wrong, in the languages of the texts
#: Of a question: whether a number is asked for, how sure the search was, its metrics (long words), and the words of which
#: one must be there. Facts of this kind come from outside; here from the question's id and words.
ASKED_SQL = """CASE WHEN item_id % 3 = 0 THEN 0.08 WHEN item_id % 3 = 1 THEN 0.06 ELSE 0.01 END"""


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The reduced evidence of each question in its three best documents: query_id, doc_id, rank, head, kept, metrics,
    factual."""
    best = text_hits(spark, sf, 3).select("query_id", "doc_id", "rank")
    docs = read(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"(\d) ", "$1 kg ").alias("text"), "source")
    asked = read(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), (F.col("item_id") % 2 == 0).alias("factual"), F.expr(ASKED_SQL).cast("double").alias("top_score"),
        F.array_distinct(text.folded_words("text", 4)).alias("terms"),
    )
    asked = asked.withColumn("metrics", F.filter("terms", lambda w: F.length(w) >= 9)).withColumn("anchors", F.when(F.col("query_id") % 5 == 0, F.slice("terms", 1, 3)).otherwise(F.array().cast("array<string>")))
    rows = docs.join(best, "doc_id").withColumn("found", reducer.sentences("text"))
    rows = rows.withColumn("lowered", F.split(F.lower(text.unmarked(F.array_join("found", "\n"))), "\n")).join(asked, "query_id")
    scores = reducer.scored(F.col("found"), F.col("lowered"), F.col("terms"), F.col("metrics"), F.col("factual"), F.col("top_score"), NEGATIVE, F.col("anchors"))
    rows = rows.withColumn("kept", reducer.reduced(scores, F.col("factual"), F.col("top_score")))
    return rows.select("query_id", "doc_id", "rank", "source", F.get("found", F.lit(0)).alias("head"), "kept", "metrics", "factual", "top_score")


EVIDENCE_SQL = BM25_SQL + r""", b AS (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 3), qa AS (SELECT item_id AS query_id, item_id % 2 = 0 AS factual, CAST(""" + ASKED_SQL + r""" AS DOUBLE) AS top_score,
    list_filter(l, lambda x, i: list_position(l, x) = i) AS terms FROM (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]{4,}') AS l FROM benchmark)),
  qm AS (SELECT *, list_filter(terms, lambda w: length(w) >= 9) AS metrics, CASE WHEN query_id % 5 = 0 THEN terms[1:3] ELSE [] END AS anchors FROM qa),
  dt AS (SELECT doc_id, source, regexp_replace(regexp_replace(text, '(\d) ', '\1 kg ', 'g'), '\|[-:\s|]+\|', ' ', 'g') AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM b)),
  dp AS (SELECT doc_id, source, string_split(regexp_replace(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), '\s+(\p{Lu}[\p{L}]{2,20}:\s)', chr(1) || '\1', 'g'), chr(1)) AS p FROM dt),
  dc AS (SELECT doc_id, source, list_filter(list_transform(p, lambda s: regexp_replace(trim(regexp_replace(regexp_replace(s, '^\s*[-*]\s*', ''), '\s+', ' ', 'g')), '^[ ;]+|[ ;]+$', '', 'g')), lambda s: length(s) >= 18) AS c FROM dp),
  ds AS (SELECT doc_id, source, list_filter(c, lambda s, i: list_position(c, s) = i) AS found FROM dc),
  js AS (SELECT b.query_id, b.doc_id, b.rank, source, found[1] AS head, factual, top_score, terms, metrics, anchors, unnest(found) AS s, generate_subscripts(found, 1) - 1 AS i, found FROM b JOIN ds USING (doc_id) JOIN qm USING (query_id)),
  jf AS (SELECT *, lower(strip_accents(s)) AS f, lower(strip_accents(found[i + 2])) AS after FROM js),
  jx AS (SELECT *, 2 * len(list_intersect(list_distinct(regexp_extract_all(f, '[\p{L}\p{N}_]+')), terms)) + CASE WHEN len(list_filter(metrics, lambda m: contains(f, m))) > 0 THEN 4 ELSE 0 END
      + CASE WHEN factual AND regexp_matches(s, '\d+[.,]?\d*\s*[%a-zA-Z°]') THEN 5 ELSE 0 END + CASE WHEN top_score >= 0.075 THEN 2 WHEN top_score >= 0.05 THEN 1 ELSE 0 END
      - CASE WHEN regexp_matches(s, '\d+[.,]?\d*\s*[%a-zA-Z°]') AND regexp_matches(f, '""" + NEGATIVE + r"""') THEN 8 ELSE 0 END - CASE WHEN coalesce(regexp_matches(after, '""" + NEGATIVE + r"""'), false) THEN 8 ELSE 0 END
      - CASE WHEN len(anchors) > 0 AND len(list_filter(anchors, lambda a: contains(f, a))) = 0 THEN 12 ELSE 0 END AS score FROM jf),
  jl AS (SELECT query_id, doc_id, list([{'i': i, 's': s, 'f': f, 'score': score}] ORDER BY score DESC, i) AS l, any_value(CASE WHEN factual THEN 3 ELSE 5 END) AS most FROM jx WHERE score >= CASE WHEN factual THEN 5 ELSE 4 END - CASE WHEN top_score >= 0.075 THEN 1 ELSE 0 END GROUP BY query_id, doc_id),
  jk AS (SELECT query_id, doc_id, list_reduce(l, lambda a, x: CASE WHEN len(a) >= most OR len(list_filter(a, lambda k: contains(k.f, x[1].f) OR contains(x[1].f, k.f))) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM jl)"""


@query("WITH " + EVIDENCE_SQL + " SELECT query_id, doc_id, CAST(x.i AS INTEGER) AS i, x.s AS s, CAST(x.score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY query_id, doc_id ORDER BY x.i) AS INTEGER) AS place FROM (SELECT query_id, doc_id, unnest(kept) AS x FROM jk)")
def ret_12(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence reduction: sentences scored against the question, with penalties; a threshold; none contained in another; the
    best three or five, in the order of the text."""
    kept = evidence(spark, sf).select("query_id", "doc_id", F.posexplode("kept").alias("p", "x"))
    return kept.select("query_id", "doc_id", "x.i", "x.s", "x.score", (F.col("p") + 1).alias("place"))


SHORT_SQL = f"CASE WHEN length({HTML_SQL.format('html')}) > 600 THEN rtrim(substr({HTML_SQL.format('html')}, 1, 597)) || '...' ELSE {HTML_SQL.format('html')} END"


@query(f"""WITH p AS (SELECT page_id // 4 AS query_id, {HOST_SQL} AS host, url, min(page_id) AS page_id FROM pages GROUP BY ALL), a AS (SELECT *, host = 'docs.example.org' OR ends_with(host, '.docs.example.org') OR host = 'www2.example.com' OR host = 'example.com' OR ends_with(host, '.example.com') AS listed FROM p),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS r FROM (SELECT *, bool_or(listed) OVER (PARTITION BY query_id) AS any_listed FROM a) WHERE listed OR NOT any_listed),
  s AS (SELECT k.query_id, k.host, k.url, page_id, {SHORT_SQL} AS body FROM k JOIN pages USING (page_id) WHERE r <= 6), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS INTEGER) AS place FROM s WHERE body <> '')
  SELECT query_id, place, host, page_id, sha256('[' || place || '] ' || url || ' (' || host || ') - ' || body) AS line_sha256 FROM n WHERE place <= 3""")
def ret_13(spark: SparkSession, sf: str) -> DataFrame:
    """Web evidence of each query: results of allowed hosts, or of all where that leaves none; one a URL, six at most; the first
    three of them with text, cut at 600 characters, as numbered lines. Four pages in a row stand for a query's results."""
    pages = read(spark, sf, "pages").withColumn("query_id", F.floor(F.col("page_id") / 4))
    one = pages.groupBy("query_id", "url").agg(F.min("page_id").alias("page_id")).withColumn("host", text.host("url"))
    listed = one.withColumn("listed", text.is_allowed(F.col("host"), ("docs.example.org", "www2.example.com", "example.com")))
    some = listed.withColumn("some", F.bool_or("listed").over(Window.partitionBy("query_id"))).where("listed or not some")
    six = top(some, ["query_id"], 6, F.asc("page_id")).select("query_id", "page_id", "host")
    bodies = six.join(pages.select("page_id", "url", "html"), "page_id").withColumn("body", text.html_to_text("html", 600)).where("body <> ''")
    three = top(bodies, ["query_id"], 3, F.asc("page_id"), name="place")
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), "url", F.lit(" ("), "host", F.lit(") - "), "body")
    return three.select("query_id", "place", "host", "page_id", F.sha2(line, 256).alias("line_sha256"))


@query("WITH " + EVIDENCE_SQL + """, r AS (SELECT DISTINCT j.query_id, j.doc_id, j.rank, j.source, head, kept, top_score FROM js AS j LEFT JOIN jk AS k ON k.query_id = j.query_id AND k.doc_id = j.doc_id),
  told AS (SELECT *, CASE WHEN kept IS NULL THEN 'head' ELSE 'reduced' END AS kind, CASE WHEN kept IS NULL THEN head ELSE array_to_string(list_transform(list_sort(list_transform(kept, lambda k: {'i': k.i, 's': k.s})), lambda k: k.s), ' ') END AS said FROM r)
  SELECT query_id, doc_id, kind, source, CASE WHEN top_score >= 0.075 THEN 'strong' WHEN top_score >= 0.05 THEN 'fair' ELSE 'weak' END AS quality, sha256(said) AS said_sha256, CAST(row_number() OVER (PARTITION BY query_id ORDER BY kind DESC, rank) AS INTEGER) AS place FROM told""")
def ret_14(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates per response: the reduced evidence where there is some, first, else the text's factual head (its first
    sentence); with source and a label of quality."""
    r = evidence(spark, sf).where("head is not null").withColumn("kind", F.when(F.size("kept") > 0, "reduced").otherwise("head"))
    said = F.when(F.col("kind") == "head", F.col("head")).otherwise(F.array_join(F.transform("kept", lambda x: x["s"]), " "))
    quality = F.when(F.col("top_score") >= 0.075, "strong").when(F.col("top_score") >= 0.05, "fair").otherwise("weak")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("kind"), "rank"))
    return r.select("query_id", "doc_id", "kind", "source", quality.alias("quality"), F.sha2(said, 256).alias("said_sha256"), place.alias("place"))


@query("WITH " + EVIDENCE_SQL + r""", u AS (SELECT query_id, doc_id, unnest(kept) AS x FROM jk), n AS (SELECT u.query_id, doc_id, x.i AS i, x.s AS s, len(list_filter(metrics, lambda m: contains(x.f, m))) > 0 AS focus FROM u JOIN qm ON qm.query_id = u.query_id WHERE factual AND regexp_matches(x.s, '\d+[.,]?\d*\s*[%a-zA-Z°]')),
  o AS (SELECT *, bool_or(focus) OVER (PARTITION BY query_id, doc_id) AS has FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY i) AS r FROM o WHERE focus OR NOT has),
  q2 AS (SELECT query_id, doc_id, string_agg(s, ' ' ORDER BY i) AS answer FROM p WHERE r <= 2 GROUP BY query_id, doc_id) SELECT * FROM q2 WHERE length(answer) <= 650""")
def ret_15(spark: SparkSession, sf: str) -> DataFrame:
    """Direct answer to a question for a number: of the reduced sentences those with a number and a unit, those that name a
    metric of the question before others, two at most; none if it is longer than 650 characters."""
    rows = evidence(spark, sf).where("factual").select("query_id", "doc_id", reducer.direct_answer(F.col("kept"), F.col("metrics")).alias("answer"))
    return rows.where("answer is not null")
