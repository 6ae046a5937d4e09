"""Table generators: one row to many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.unicode import nfkc
from ..operators import chunking, evidence, sections
from .base import query, read
from .windows import HEADED_SQL, LINES_SQL, with_headings


@query()
def gen_01(spark: SparkSession, sf: str) -> DataFrame:
    """Recursive chunking (tested by invariants)."""
    return chunking.chunk_documents(read(spark, sf, "documents"))


@query("SELECT doc_id, CAST((s - 1) / 600 AS INTEGER) AS i, sha256(substr(text, CAST(s AS BIGINT), 800)) AS chunk FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 600)) AS s FROM documents)")
def gen_02(spark: SparkSession, sf: str) -> DataFrame:
    """Character windows with overlap."""
    parts = read(spark, sf, "documents").select("doc_id", F.posexplode(chunking.windows("text")).alias("i", "c"))
    return parts.select("doc_id", "i", F.sha2("c", 256).alias("chunk"))


SECTIONS_SQL = HEADED_SQL + """, sec AS (SELECT doc_id, section, max(path) AS path, coalesce(regexp_replace(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), '^\\s+|\\s+$', '', 'g'), '') AS body FROM paths GROUP BY doc_id, section),
  parts AS (SELECT doc_id, section, path, CASE WHEN path = '' THEN body ELSE path || chr(10) || body END AS chunk FROM sec WHERE body <> '')"""


@query("WITH " + SECTIONS_SQL + " SELECT doc_id, CAST(section AS INTEGER) AS section, path, length(chunk) > 360 AS oversize, CASE WHEN length(chunk) <= 360 THEN sha256(chunk) END AS chunk FROM parts")
def gen_03(spark: SparkSession, sf: str) -> DataFrame:
    """Sections with their path of headings in front; the ones that are too long show as such (headings and fences are
    injected). gen_03_chunks has what these are cut into."""
    chunks = sections.section_chunks(with_headings(spark, sf), size=240, overlap=60).where("i = 0")
    return chunks.select("doc_id", "section", "path", "oversize", F.when(~F.col("oversize"), F.sha2("chunk", 256)).alias("chunk"))


@query()
def gen_03_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks of all sections, the long ones cut by recursive chunking (tested against a loop)."""
    return sections.section_chunks(with_headings(spark, sf), size=240, overlap=60).select("doc_id", "section", "i", "chunk")


@query()
def gen_04(spark: SparkSession, sf: str) -> DataFrame:
    """Heading-only chunks join their successors (tested against a loop)."""
    t = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("# "), i.cast("string"))).otherwise(x))
    return read(spark, sf, "documents").select("doc_id", F.posexplode(chunking.merge_headings(t, 400)).alias("i", "chunk"))


#: How documents of a type are cut: size, overlap, how much longer a section may be, and the most it may have.
#: A glossary is cut in windows. The languages of the texts stand for types.
TYPES = {"en": ("legislation", 600, 100, 2.4, 1600), "de": ("manual", 450, 90, 1.5, None), "fr": ("glossary", 900, 150, None, None), "es": ("report", 300, 60, 1.5, None)}


@query(
    "WITH " + SECTIONS_SQL + ", k AS (SELECT doc_id, lang, text FROM documents), s AS (SELECT p.doc_id, CASE lang WHEN 'en' THEN 'legislation' WHEN 'de' THEN 'manual' ELSE 'report' END AS doc_type, CAST(section AS INTEGER) AS section, 0 AS i, length(chunk) > CASE lang WHEN 'en' THEN 1440 WHEN 'de' THEN 675 ELSE 450 END AS oversize, chunk FROM parts AS p JOIN k ON k.doc_id = p.doc_id WHERE lang <> 'fr'),"
    " w AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM paths GROUP BY doc_id), f AS (SELECT doc_id, 'glossary' AS doc_type, 0 AS section, CAST((b - 1) / 750 AS INTEGER) AS i, false AS oversize, substr(t, CAST(b AS BIGINT), 900) AS chunk FROM (SELECT w.doc_id, t, unnest(range(1, greatest(length(t), 1) + 1, 750)) AS b FROM w JOIN k ON k.doc_id = w.doc_id WHERE lang = 'fr'))"
    " SELECT doc_id, doc_type, section, i, oversize, CASE WHEN NOT oversize THEN sha256(chunk) END AS chunk FROM (SELECT * FROM s UNION ALL SELECT * FROM f)"
)
def gen_05(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by document type: sections with the size, ratio and cap of their type, windows for glossaries (types come from
    the language, headings are injected; of a section that is too long the first chunk shows that it is)."""
    kinds = F.broadcast(spark.createDataFrame([(k, *v) for k, v in TYPES.items()], "lang string, doc_type string, size int, overlap int, ratio double, most int"))  # fixed and small
    docs = with_headings(spark, sf).join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").join(kinds, "lang")
    cut = sections.section_chunks(docs.where("doc_type <> 'glossary'"), F.col("size"), F.col("overlap"), F.col("ratio"), F.coalesce("most", F.lit(1 << 30)), carry=("doc_type",)).where("i = 0")
    fixed = docs.where("doc_type = 'glossary'").select("doc_id", "doc_type", F.lit(0).alias("section"), F.posexplode(chunking.windows("text", 900, 150)).alias("i", "chunk"), F.lit(False).alias("oversize"))
    columns = ["doc_id", "doc_type", "section", "i", "oversize", F.when(~F.col("oversize"), F.sha2("chunk", 256)).alias("chunk")]
    return cut.select(*columns).unionByName(fixed.select(*columns))


@query("WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, ', ', ' Note: ') ELSE text END AS t FROM documents), p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(t, '\\|[-:\\s|]+\\|', ' ', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\s+(\\p{Lu}[\\p{L}]{2,20}:\\s)', chr(1) || '\\1', 'g'), chr(1)) AS p FROM t) SELECT DISTINCT doc_id, s AS sentence FROM (SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(unnest(p), '^\\s*[-*]\\s*', ''), '\\s+', ' ', 'g')), '^[ ;]+|[ ;]+$', '', 'g') AS s FROM p) WHERE length(s) >= 18")
def gen_06(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct sentences of eighteen characters or more, cut before labels too (labels are injected)."""
    t = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(", "), F.lit(" Note: "))).otherwise(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.explode(evidence.sentences("t")).alias("sentence"))


LOW_PRECISION = ("that", "with", "der", "les", "is", "for")  # words that say little alone, in the languages of the texts


@query("WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: x NOT IN ('the', 'of', 'and', 'in', 'to')) AS w FROM benchmark) SELECT item_id, gram, count(*) AS n FROM (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM w) WHERE gram NOT IN ('that', 'with', 'der', 'les', 'is', 'for') AND NOT regexp_matches(gram, '^.{1,2}$') GROUP BY item_id, gram")
def gen_07(spark: SparkSession, sf: str) -> DataFrame:
    """Word n-grams of one to three, without stop words; words that say little alone, or are too short, are no grams of their own."""
    w = F.filter(text.words(F.lower("text"), 1), lambda x: ~x.isin("the", "of", "and", "in", "to"))
    rows = read(spark, sf, "benchmark").select("item_id", w.alias("w"))
    def grams_of(n: int) -> F.Column:
        some = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice(F.col("w"), i, F.lit(n)), " "))
        return F.when(F.size("w") >= n, some).otherwise(F.array().cast("array<string>"))

    grams = [grams_of(n) for n in (1, 2, 3)]
    return rows.select("item_id", F.explode(F.concat(*grams)).alias("gram")).where(~F.col("gram").isin(*LOW_PRECISION) & (F.length("gram") > 2)).groupBy("item_id", "gram").agg(F.count("*").alias("n"))


#: Lines of a document as a glossary in one of four forms, by its id: a table, labelled lines under records, arrows, colons.
WORD_SQL = "regexp_extract(line, '[\\p{L}]+')"
GLOSSARY_LINE_SQL = f"""CASE doc_id % 4
  WHEN 0 THEN CASE i % 7 WHEN 1 THEN '| Term | Substitution |' WHEN 2 THEN '|---|:--:|' ELSE '| ' || {WORD_SQL} || ' |  ' || reverse({WORD_SQL}) || '; | x |' END
  WHEN 1 THEN CASE i % 6 WHEN 1 THEN '## Record ' || i WHEN 2 THEN '- Term: ' || {WORD_SQL} WHEN 5 THEN '* substitution:  ' || reverse({WORD_SQL}) || '.' WHEN 4 THEN 'Equivalente: ' || {WORD_SQL} || ' 4' ELSE 'plain' END
  WHEN 2 THEN CASE i % 3 WHEN 0 THEN 'nota: none' WHEN 1 THEN 'Termo: ' || {WORD_SQL} ELSE {WORD_SQL} || ' -> ' || i % 4 END
  ELSE CASE i % 4 WHEN 0 THEN 'Fonte: ' || {WORD_SQL} WHEN 1 THEN 'substituição: carried' ELSE {WORD_SQL} || ' : ' || i % 5 END END"""


@query(
    "WITH " + LINES_SQL + f""", g AS (SELECT doc_id, i, {WORD_SQL} AS w, doc_id % 4 AS form FROM l),
    e AS (SELECT *, CASE form WHEN 0 THEN CASE WHEN i % 7 NOT IN (1, 2) THEN 'own' END WHEN 1 THEN CASE i % 6 WHEN 1 THEN 'record' WHEN 2 THEN CASE WHEN w <> '' THEN 'term' END WHEN 5 THEN 'last' WHEN 4 THEN 'last' END
      WHEN 2 THEN CASE i % 3 WHEN 1 THEN CASE WHEN w <> '' THEN 'term' END WHEN 2 THEN 'own' END ELSE CASE WHEN i % 4 IN (2, 3) THEN CASE WHEN w <> '' THEN 'own' END END END AS kind,
      CASE form WHEN 0 THEN reverse(w) WHEN 1 THEN CASE i % 6 WHEN 5 THEN reverse(w) ELSE w || ' 4' END WHEN 2 THEN CAST(i % 4 AS VARCHAR) ELSE CAST(i % 5 AS VARCHAR) END AS m FROM g),
    r AS (SELECT *, count(*) FILTER (WHERE kind IN ('record', 'term', 'own')) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e WHERE kind IS NOT NULL),
    p AS (SELECT doc_id, run, max(CASE WHEN kind IN ('own', 'term') THEN w END) AS term, CASE WHEN bool_or(kind = 'own') THEN max(CASE WHEN kind = 'own' THEN m END) ELSE arg_max(CASE WHEN kind = 'last' THEN trim(m) END, CASE WHEN kind = 'last' AND trim(m) <> '' THEN i END) END AS meaning FROM r GROUP BY doc_id, run)
    SELECT doc_id, term, meaning FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(term), lower(meaning) ORDER BY run) AS n FROM p WHERE term <> '' AND meaning <> '') WHERE n = 1"""
)
def gen_08(spark: SparkSession, sf: str) -> DataFrame:
    """Glossary entries of all four forms, distinct in a document (the lines are injected; the texts give the words)."""
    w, i = lambda x: F.regexp_extract(x, r"([\p{L}]+)", 1), lambda k: (k + 1)
    text_of = lambda *parts: F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])

    def line(x: F.Column, k: F.Column) -> F.Column:
        n, form = i(k), F.col("doc_id") % 4
        number = lambda m: (n % m).cast("string")
        table = F.when(n % 7 == 1, "| Term | Substitution |").when(n % 7 == 2, "|---|:--:|").otherwise(text_of("| ", w(x), " |  ", F.reverse(w(x)), "; | x |"))
        records = F.when(n % 6 == 1, text_of("## Record ", n.cast("string"))).when(n % 6 == 2, text_of("- Term: ", w(x))).when(n % 6 == 5, text_of("* substitution:  ", F.reverse(w(x)), ".")).when(n % 6 == 4, text_of("Equivalente: ", w(x), " 4")).otherwise("plain")
        arrows = F.when(n % 3 == 0, "nota: none").when(n % 3 == 1, text_of("Termo: ", w(x))).otherwise(text_of(w(x), " -> ", number(4)))
        colons = F.when(n % 4 == 0, text_of("Fonte: ", w(x))).when(n % 4 == 1, "substituição: carried").otherwise(text_of(w(x), " : ", number(5)))
        return F.when(form == 0, table).when(form == 1, records).when(form == 2, arrows).otherwise(colons)

    texts = read(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("t")).withColumn("t", nfkc("t"))
    return texts.select("doc_id", F.explode(sections.glossary("t")).alias("e")).select("doc_id", "e.term", "e.meaning")


@query("WITH " + LINES_SQL + ", f AS (SELECT doc_id, i, trim(regexp_replace('y' || doc_id % 9 || ' =  a *  ' || i, '\\s+', ' ', 'g')) AS formula FROM l WHERE regexp_matches(line, '\\d')) SELECT doc_id, CAST(i AS INTEGER) AS i, formula FROM (SELECT *, row_number() OVER (PARTITION BY formula ORDER BY doc_id, i) AS r FROM f) WHERE r = 1 ORDER BY doc_id, i LIMIT 50")
def gen_09(spark: SparkSession, sf: str) -> DataFrame:
    """Formula lines, normalised, one per formula, fifty at most (formulas are injected where a line holds a number)."""
    lines = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.col("line").rlike(r"\d")).select("doc_id", (F.col("p") + 1).alias("i"))
    f = lines.withColumn("formula", text.collapse(F.concat(F.lit("y"), (F.col("doc_id") % 9).cast("string"), F.lit(" =  a *  "), F.col("i").cast("string"))))
    first = f.groupBy("formula").agg(F.min(F.struct("doc_id", "i")).alias("x")).select("x.doc_id", "x.i", "formula")
    return first.orderBy("doc_id", "i").limit(50)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS content, round(value / 100, 6) AS score FROM events")
def gen_10(spark: SparkSession, sf: str) -> DataFrame:
    """Tool payloads flattened: the list lies under one of several names, text and score under others."""
    e = read(spark, sf, "events")
    item = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "text": "'), "event_type", F.lit('", "relevance": '), F.round(F.col("value") / 100, 6).cast("string"), F.lit("}"))
    payload = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"results": ['), item, F.lit("]}"))).otherwise(F.concat(F.lit('{"matches": ['), item, F.lit("]}")))
    kind = "array<struct<k: bigint, content: string, text: string, score: double, relevance: double>>"
    rows = F.coalesce(*[F.from_json(F.get_json_object(payload, f"$.{n}"), kind) for n in ("results", "chunks", "items", "data", "documents", "matches")])
    return e.select("event_id", F.explode(rows).alias("r")).select("event_id", "r.k", F.coalesce("r.content", "r.text").alias("content"), F.coalesce("r.score", "r.relevance").alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN place END AS place, CASE WHEN event_id % 4 <> 0 THEN CASE place WHEN 0 THEN event_type ELSE 'second' END END AS content, CASE WHEN event_id % 4 <> 0 AND place = 0 THEN round(value, 3) END AS score, CASE WHEN event_id % 4 <> 0 AND place = 0 THEN 'user ' || user_id END AS source FROM events, (VALUES (0), (1)) AS p(place) WHERE place = 0 OR event_id % 4 <> 0")
def gen_11(spark: SparkSession, sf: str) -> DataFrame:
    """Trace chunks from a JSON array of content, score and source, any of which may be missing; bad JSON gives an empty row."""
    item = F.to_json(F.struct(F.col("event_type").alias("content"), F.round("value", 3).alias("score"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("source")))
    raw = F.when(F.col("event_id") % 4 == 0, F.lit('[{"content": "broken')).otherwise(F.concat(F.lit("["), item, F.lit(', {"content": "second"}]')))
    parsed = F.from_json(raw, "array<struct<content: string, score: double, source: string>>")
    return read(spark, sf, "events").select("event_id", F.posexplode_outer(F.filter(parsed, lambda x: x["content"].isNotNull())).alias("place", "x")).select("event_id", "place", "x.content", "x.score", "x.source")
