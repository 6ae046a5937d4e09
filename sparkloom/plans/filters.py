"""Projections, predicates and filters over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import postings, vectors
from ..operators.ranking import top
from .base import query, read

STRIP_SQL = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def asking(spark: SparkSession, sf: str) -> DataFrame:
    """The stated queries over vectors: every row whose id is divisible by 100."""
    return read(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def searched(spark: SparkSession, sf: str, k: int = 8) -> DataFrame:
    """Search output used by several queries: rows with vec_id % 100 = 0 ask, all rows answer."""
    return vectors.nearest(asking(spark, sf), read(spark, sf, "embeddings").select("vec_id", "embedding"), k)


SEARCHED_SQL = """scored AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings AS q JOIN embeddings AS v ON q.vec_id % 100 = 0),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored) WHERE rank <= {k})"""

FOLDED_WORDS_SQL = "regexp_extract_all(lower(strip_accents({0})), '[\\p{{L}}\\p{{N}}_]{{{1},}}')"


def bm25_sql(asked: str, docs: str) -> str:
    """Common table expressions of BM25: bm(query_id, doc_id, score, matched) for asked(query_id, text), docs(doc_id, text)."""
    return f"""w AS (SELECT doc_id, {FOLDED_WORDS_SQL.format("text", 4)} AS w FROM ({docs}) WHERE text IS NOT NULL), t AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean FROM w),
  q AS (SELECT query_id, unnest(list_distinct({FOLDED_WORDS_SQL.format("text", 4)})) AS term FROM ({asked})),
  tf AS (SELECT term, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w) GROUP BY term, doc_id, len), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM
    (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score, count(*) AS matched FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN t GROUP BY query_id, doc_id))"""


BM25_SQL = bm25_sql("SELECT item_id AS query_id, text FROM benchmark", "SELECT doc_id, text FROM documents")


def text_hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """The k best documents of every benchmark text by BM25: query_id, doc_id, score, matched, rank."""
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return postings.bm25_top(asked, read(spark, sf, "documents").select("doc_id", "text"), k)


def keyword_hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """text_hits with n_keywords of the question, and how many of them the document's text holds as substrings."""
    docs, asked = read(spark, sf, "documents", "benchmark")
    docs = docs.select("doc_id", F.lower("text").alias("t"))
    asked = asked.select(F.col("item_id").alias("query_id"), text.keywords("text").alias("kw"))
    joined = text_hits(spark, sf, k).join(docs, "doc_id").join(asked, "query_id")
    return joined.select("query_id", "doc_id", "score", "rank", F.size("kw").alias("n_keywords"), F.size(F.filter("kw", lambda x: F.contains(F.col("t"), x))).alias("held"))


KEYWORDS_SQL = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]{{4,}}'))"
KEYWORD_HITS_SQL = BM25_SQL + f""", kh AS (SELECT query_id, doc_id, score, rank, len(kw) AS n_keywords, len(list_filter(kw, lambda x: contains(lower(text), x))) AS held
  FROM bm JOIN documents USING (doc_id) JOIN (SELECT item_id AS query_id, {KEYWORDS_SQL.format("text")} AS kw FROM benchmark) USING (query_id) WHERE rank <= 8)"""


@query(f"SELECT doc_id FROM (SELECT doc_id, {STRIP_SQL} AS t FROM documents) WHERE length(t) >= 60 AND len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]')) / greatest(length(t), 1) >= 0.25")
def flt_01(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk quality."""
    return read(spark, sf, "documents").where(text.is_good_chunk("text")).select("doc_id")


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE len(regexp_extract_all(line, '[\\p{L}\\p{N}]')) >= 15 GROUP BY doc_id")
def flt_02(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with enough letters and digits, counted per document."""
    lines = read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(text.alphanumerics("line") >= 15).groupBy("doc_id").agg(F.count("*").alias("n"))


GLOSSARY_SQL = "doc_id % 7 = 0"  # the texts have no type: every seventh counts as an entry of a glossary
GATE_SQL = f"""gc AS (SELECT doc_id, CASE WHEN {GLOSSARY_SQL} THEN 250 ELSE 400 END AS mc, CASE WHEN {GLOSSARY_SQL} THEN 30 ELSE 80 END AS mw, length(text)::DOUBLE AS c, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]{{2,}}'))::DOUBLE AS w,
  len(regexp_extract_all(text, '[ÃÂÐÑ\\x{{FFFD}}\\x00]'))::DOUBLE AS odd, (""" + " + ".join(f"len(regexp_extract_all(text, '{m}'))" for m in text.MOJIBAKE) + """)::DOUBLE AS marks FROM documents),
gs AS (SELECT *, odd / greatest(c, 1) AS g1, marks / greatest(w, 1) AS g2, round(100 * (0.35::DOUBLE * least(c / mc, 1) + 0.35::DOUBLE * least(w / mw, 1) + 0.30::DOUBLE * greatest(1 - odd / greatest(c, 1) / 0.08::DOUBLE, 0)) + 1e-9, 2) AS score FROM gc),
g AS (SELECT doc_id, score, round(g1 + 1e-12, 6) AS garbled, round(g2 + 1e-12, 6) AS mojibake,
  array_to_string(list_filter([CASE WHEN c < mc THEN 'too short' END, CASE WHEN w < mw THEN 'too few words' END, CASE WHEN g1 > 0.08 THEN 'odd characters' END, CASE WHEN g2 > 0.03 THEN 'wrong decoding' END, CASE WHEN score < 60 THEN 'low score' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM gs)"""


def gated(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.expr(GLOSSARY_SQL), "glossary").otherwise("manual")
    return read(spark, sf, "documents").select("doc_id", text.quality("text", kind).alias("q")).select("doc_id", "q.*")


@query("WITH " + GATE_SQL + " SELECT doc_id, score, garbled, mojibake, reasons FROM g")
def flt_03(spark: SparkSession, sf: str) -> DataFrame:
    """Document quality score, the shares behind it, and reasons to reject."""
    return gated(spark, sf).select("doc_id", "score", "garbled", "mojibake", F.array_join("reasons", "; ").alias("reasons"))


@query("WITH " + GATE_SQL + " SELECT doc_id, substr(reasons, 1, 1000) AS reason FROM g WHERE reasons <> ''")
def flt_04(spark: SparkSession, sf: str) -> DataFrame:
    """The rejected output of the gate."""
    return gated(spark, sf).where(F.size("reasons") > 0).select("doc_id", F.substring(F.concat_ws("; ", "reasons"), 1, 1000).alias("reason"))


@query("WITH " + SEARCHED_SQL.format(k=1) + " SELECT query_id, vec_id, score FROM scored WHERE score >= 0.3")
def flt_05(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity threshold: all rows that reach it, however many."""
    return vectors.nearest(asking(spark, sf), read(spark, sf, "embeddings"), None, threshold=0.3).select("query_id", "vec_id", "score")


@query("WITH " + SEARCHED_SQL.format(k=8) + " SELECT query_id, vec_id, score FROM hits WHERE label = 0 OR score >= 0.22")
def flt_06(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance gate of vector scores; regulatory rows (label 0) pass."""
    labels = read(spark, sf, "embeddings").select("vec_id", "label")
    return searched(spark, sf).join(labels, "vec_id").where("label = 0 or score >= 0.22").select("query_id", "vec_id", "score")


@query("WITH " + SEARCHED_SQL.format(k=8) + " SELECT query_id, count(*) FILTER (WHERE label <> query_id // 100 % 10 AND score >= 0.25) AS kept, count(*) FILTER (WHERE label <> query_id // 100 % 10 AND score < 0.25) AS skipped FROM hits GROUP BY query_id")
def flt_07(spark: SparkSession, sf: str) -> DataFrame:
    """Complement gate: rows of other domains kept and skipped."""
    labels = read(spark, sf, "embeddings").select("vec_id", "label")
    other = F.col("label") != F.floor(F.col("query_id") / 100) % 10
    return searched(spark, sf).join(labels, "vec_id").groupBy("query_id").agg(F.count_if(other & (F.col("score") >= 0.25)).alias("kept"), F.count_if(other & (F.col("score") < 0.25)).alias("skipped"))


HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"


@query(f"SELECT page_id, h AS host, h = 'example.com' OR ends_with(h, '.example.com') OR h = 'example.org' OR ends_with(h, '.example.org') AS allowed FROM (SELECT page_id, {HOST_SQL} AS h FROM pages)")
def flt_08(spark: SparkSession, sf: str) -> DataFrame:
    """Domain allow-list."""
    pages = read(spark, sf, "pages").select("page_id", text.host("url").alias("host"))
    return pages.select("page_id", "host", text.is_allowed(F.col("host"), ("example.com", "example.org")).alias("allowed"))


@query("SELECT lang, count(*) FILTER (WHERE text LIKE '%Ã%' OR text LIKE '%Â%') AS odd, count(*) FILTER (WHERE regexp_matches(text, '^#+ [^\\n]*$')) AS headings, min(substr(text, 1, 240)) AS preview FROM documents GROUP BY lang")
def flt_09(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus sanity: odd decodings, heading-only rows, a preview."""
    docs = read(spark, sf, "documents")
    return docs.groupBy("lang").agg(F.count_if(F.col("text").contains("Ã") | F.col("text").contains("Â")).alias("odd"), F.count_if(F.col("text").rlike(r"^#+ [^\n]*$")).alias("headings"), F.min(F.substring("text", 1, 240)).alias("preview"))


@query("WITH " + KEYWORD_HITS_SQL + " SELECT query_id, max(score) < 12 AND max(held) < 2 AND any_value(n_keywords) >= 3 AS weak FROM kh WHERE rank <= 3 GROUP BY query_id")
def flt_10(spark: SparkSession, sf: str) -> DataFrame:
    """Weak evidence: of the first three rows the best score is low and none holds two of the question's three or more
    keywords. The bound of the score is that of the scale used here, BM25."""
    first = keyword_hits(spark, sf, 3).groupBy("query_id").agg(F.max("score").alias("best"), F.max("held").alias("held"), F.first("n_keywords").alias("n"))
    return first.select("query_id", ((F.col("best") < 12) & (F.col("held") < 2) & (F.col("n") >= 3)).alias("weak"))


@query("WITH " + KEYWORD_HITS_SQL + f", a AS (SELECT item_id AS query_id, len({KEYWORDS_SQL.format('text')}) AS n FROM benchmark) SELECT a.query_id, count(kh.doc_id) < 3 OR (n > 0 AND coalesce(max(held) FILTER (WHERE rank <= 3), 0) < least(n, 2)) AS again FROM a LEFT JOIN kh USING (query_id) GROUP BY a.query_id, n")
def flt_11(spark: SparkSession, sf: str) -> DataFrame:
    """Second-pass predicate: fewer than three rows, or the best of the first three holds fewer than two of the keywords (all,
    if there are fewer). Questions without rows survive the left join; without keywords the rows decide alone."""
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.size(text.keywords("text")).alias("n"))
    rows = keyword_hits(spark, sf, 8).groupBy("query_id").agg(F.count("*").alias("rows"), F.max(F.when(F.col("rank") <= 3, F.col("held"))).alias("held"))
    few = F.coalesce("rows", F.lit(0)) < 3
    return asked.join(rows, "query_id", "left").select("query_id", (few | ((F.col("n") > 0) & (F.coalesce("held", F.lit(0)) < F.least("n", F.lit(2))))).alias("again"))


LIMIT_SIGNAL = r"(^|[^\p{L}])(max|min|limit|of the|dans les|und das)([^\p{L}]|$)"  # words of limits, in the languages of the texts


@query(
    "WITH " + BM25_SQL + f", c AS (SELECT query_id AS item_id, doc_id, {KEYWORDS_SQL.format('b.text')} AS kw, {KEYWORDS_SQL.format('d.text')} AS dw, regexp_matches(d.text, '\\d') AS has, regexp_matches(lower(d.text), '{LIMIT_SIGNAL}') AS limits FROM bm JOIN benchmark AS b ON b.item_id = query_id JOIN documents AS d USING (doc_id) WHERE rank <= 20),"
    " f AS (SELECT item_id, doc_id, len(list_intersect(kw, dw)) AS n, len(list_intersect(list_filter(kw, lambda w: length(w) >= 9), dw)) > 0 AS topic, len(list_intersect(list_filter(kw, lambda w: length(w) BETWEEN 7 AND 8), dw)) > 0 AS product, has, limits FROM c)"
    " SELECT item_id, doc_id, CAST(n AS INTEGER) AS n_shared, topic, product FROM f WHERE (topic AND product) OR (topic AND n >= 2) OR n >= 6 OR (limits AND has AND n >= 2)"
)
def flt_12(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence relevance of the twenty best documents of each question: the topic matches and a product does too or two terms
    are shared; or many terms are shared; or the evidence speaks of a limit, has a number and shares two terms. Topics are
    the question's words of nine letters and more, products those of seven and eight. The predicate looks at evidence that
    a search has found, so common terms bring no further pairs."""
    items, docs = read(spark, sf, "benchmark", "documents")
    items = items.select(F.col("item_id").alias("query_id"), text.keywords("text").alias("kw"))
    docs = docs.select("doc_id", text.keywords("text").alias("dw"), F.col("text").rlike(r"\d").alias("has"), F.lower("text").rlike(LIMIT_SIGNAL).alias("limits"))
    pairs = text_hits(spark, sf, 20).select("query_id", "doc_id").join(docs, "doc_id").join(items, "query_id")
    shared = pairs.select(F.col("query_id").alias("item_id"), "doc_id", F.array_intersect("kw", "dw").alias("s"), "has", "limits")
    held = lambda low, high: F.exists("s", lambda w: F.length(w).between(low, high))
    f = shared.select("item_id", "doc_id", F.size("s").alias("n_shared"), held(9, 1 << 30).alias("topic"), held(7, 8).alias("product"), "has", "limits")
    n = F.col("n_shared")
    return f.where((F.col("topic") & (F.col("product") | (n >= 2))) | (n >= 6) | (F.col("limits") & F.col("has") & (n >= 2))).select("item_id", "doc_id", "n_shared", "topic", "product")


@query("SELECT item_id, agent FROM (SELECT item_id, item_id % 4 AS agent, row_number() OVER (PARTITION BY item_id % 4 ORDER BY md5(CAST(item_id AS VARCHAR) || '-42')) AS r FROM benchmark) WHERE r <= 5 ORDER BY agent, r LIMIT 15")
def flt_13(spark: SparkSession, sf: str) -> DataFrame:
    """Case selection: a seeded sample per agent, and a total limit. Sampling is the feature."""
    cases = read(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 4).alias("agent"))
    some = top(cases, ["agent"], 5, F.md5(F.concat(F.col("item_id").cast("string"), F.lit("-42"))))
    return some.orderBy("agent", "rank").limit(15).select("item_id", "agent")
