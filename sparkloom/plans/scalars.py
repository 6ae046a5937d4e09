"""Scalar functions over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents, formulas, text, unicode
from .base import query, read

FOLD_SQL = "trim(regexp_replace(regexp_replace(lower(translate({0}, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '\\s+', ' ', 'g'), '^ | $', '', 'g'))"
COLLAPSE_SQL = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
WORDS_SQL = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]{{{1},}}')"
#: Characters that a normal form takes apart or puts together; the given texts hold none. Then what NFKD without marks, lower
#: case and collapsed blanks make of them, and what NFKC does.
ODD = " \ufb01n\u00a0\u00bd \uff21\uff42 o\u0301\u0323 \u1e69 \u212b \ud55c"
ODD_FOLDED = " fin 1\u20442 ab o s a \u1112\u1161\u11ab"
ODD_COMPOSED = " fin 1\u20442 Ab \u1ecd\u0301 \u1e69 \u00c5 \ud55c"


def with_odd(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, every third one with odd characters at its end."""
    return read(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(ODD))).otherwise(F.col("text")))


@query("SELECT doc_id, sha256(" + FOLD_SQL.format("text") + f" || CASE WHEN doc_id % 3 = 0 THEN '{ODD_FOLDED}' ELSE '' END) AS folded_sha256 FROM documents")
def scl_01(spark: SparkSession, sf: str) -> DataFrame:
    """Folding for comparison, also of ligatures, fractions, full-width letters, combining marks and syllables (injected)."""
    return with_odd(spark, sf).select("doc_id", F.sha2(text.fold("text"), 256).alias("folded_sha256"))


STOP = ("that", "with", "from", "this", "sich", "eine", "para")


@query(
    "SELECT item_id, array_to_string(list_filter(list_distinct_ordered, lambda w: w NOT IN ('that','with','from','this','sich','eine','para')), ' ') AS keywords FROM (SELECT item_id, list_filter(l, lambda w, i: list_position(l, w) = i) AS list_distinct_ordered FROM (SELECT item_id, "
    + WORDS_SQL.format("lower(text)", 4)
    + " AS l FROM benchmark))"
)
def scl_02(spark: SparkSession, sf: str) -> DataFrame:
    """Query keywords."""
    return read(spark, sf, "benchmark").select("item_id", F.array_join(text.keywords("text", STOP), " ").alias("keywords"))


@query("SELECT doc_id, CAST(len(" + WORDS_SQL.format("text", 2) + ") AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def scl_03(spark: SparkSession, sf: str) -> DataFrame:
    """Word and character counts."""
    return read(spark, sf, "documents").select("doc_id", F.size(text.words("text")).cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"))


@query("SELECT page_id, lower(" + COLLAPSE_SQL.format("list_extract(string_split(replace(url, '\\', '/'), '/'), -1)") + ") AS source_name FROM (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN ' fin ab' ELSE '' END AS url FROM pages)")
def scl_04(spark: SparkSession, sf: str) -> DataFrame:
    """Source name: the last path element in NFKC, collapsed, in lower case (compatibility characters are injected)."""
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, " \ufb01n\u3000\uff21\uff42").otherwise(""))
    parts = F.split(F.translate(unicode.nfkc(url), "\\", "/"), "/")
    return read(spark, sf, "pages").select("page_id", F.lower(text.collapse(F.element_at(parts, -1))).alias("source_name"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-4]$') THEN 'glossary' WHEN regexp_matches(source, '^src1[0-9]$') THEN 'report'
    WHEN regexp_matches(lower(substr(text, 1, 3000)), 'licen[cs]e|copyright') THEN 'legal' WHEN regexp_matches(lower(substr(text, 1, 3000)), '\\d+[.,]\\d+') THEN 'data' ELSE 'manual' END AS doc_type FROM documents"""
)
def scl_05(spark: SparkSession, sf: str) -> DataFrame:
    """Document type by name rules, then by rules on the first 3000 characters."""
    head = F.lower(F.substring("text", 1, 3000))
    kind = F.when(F.col("source").rlike("^src[0-4]$"), "glossary").when(F.col("source").rlike("^src1[0-9]$"), "report").when(head.rlike("licen[cs]e|copyright"), "legal").when(head.rlike(r"\d+[.,]\d+"), "data")
    return read(spark, sf, "documents").select("doc_id", kind.otherwise("manual").alias("doc_type"))


LAW = "concat('Title ', lang, ' > Section ', CAST(doc_id AS VARCHAR), chr(10), 'Art. ', CAST(doc_id % 40 AS VARCHAR), ' par. ', CAST(doc_id % 7 AS VARCHAR), ' ', substr(text, 1, 80))"


@query(
    f"SELECT doc_id, string_split(line, ' > ')[1] AS title, string_split(line, ' > ')[-1] AS leaf, regexp_extract(t, 'Art\\. (\\d+)', 1) AS article, regexp_extract(t, 'par\\. (\\d+)', 1) AS paragraph FROM (SELECT doc_id, t, string_split(t, chr(10))[1] AS line FROM (SELECT doc_id, {LAW} AS t FROM documents))"
)
def scl_06(spark: SparkSession, sf: str) -> DataFrame:
    """Section path, article and paragraph of a legal chunk (headings are injected, as the corpus has none)."""
    t = F.concat(F.lit("Title "), "lang", F.lit(" > Section "), F.col("doc_id").cast("string"), F.lit("\nArt. "), (F.col("doc_id") % 40).cast("string"), F.lit(" par. "), (F.col("doc_id") % 7).cast("string"), F.lit(" "), F.substring("text", 1, 80))
    path = F.split(F.element_at(F.split(F.col("t"), "\n"), 1), " > ")
    return read(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", path[0].alias("title"), F.element_at(path, -1).alias("leaf"), F.regexp_extract("t", r"Art\. (\d+)", 1).alias("article"), F.regexp_extract("t", r"par\. (\d+)", 1).alias("paragraph"))


HTML_SQL = "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"


@query("SELECT page_id, sha256(" + HTML_SQL.format("html") + ") AS text_sha256, CAST(length(" + HTML_SQL.format("html") + ") AS BIGINT) AS n_chars FROM pages")
def scl_07(spark: SparkSession, sf: str) -> DataFrame:
    """HTML to text."""
    pages = read(spark, sf, "pages").select("page_id", text.html_to_text("html").alias("t"))
    return pages.select("page_id", F.sha2("t", 256).alias("text_sha256"), F.length("t").cast("long").alias("n_chars"))


#: UTF-8 read as Latin-1 turns a letter of U+0080 to U+00FF into two, the first of them one of the two that tell.
HIT_SQL = "len(regexp_extract_all(text, '[\\x{80}-\\x{FF}]'))"
UPPER_SQL = "len(regexp_extract_all(text, '[\\x{C0}-\\x{FF}]'))"
CP1252 = tuple("".join(x) for x in zip(*((chr(b), c) for c, b in unicode.CP1252.items() if ord(c) > 0xFF), strict=True))
CURLY = " \u201cone\u201d \u2013 two\u2026"


@query(f"""WITH d AS (SELECT doc_id, doc_id % 3 AS kind, {HIT_SQL} AS hits, {UPPER_SQL} > 0 AS upper, text = ascii_only AS plain, len(regexp_extract_all(text, '[ÃÂ]')) AS own, text
    FROM (SELECT doc_id, text, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS ascii_only FROM documents))
  SELECT doc_id, CAST(CASE kind WHEN 0 THEN hits WHEN 1 THEN own ELSE hits + 6 END AS BIGINT) AS markers, CASE kind WHEN 0 THEN hits < 3 ELSE kind = 1 END AS untouched,
  CASE kind WHEN 0 THEN plain OR (hits >= 3 AND upper) ELSE kind = 1 END AS restored FROM d""")
def scl_08(spark: SparkSession, sf: str) -> DataFrame:
    """Mojibake: every third text is garbled by reading its UTF-8 as Latin-1, every third one, with curly quotes, as cp1252;
    the others stay and have curly quotes. How many signs a text shows, whether it was left alone, and whether it is the
    original again. A text with two signs is left garbled, as the bound says; of a reading as cp1252 letters come back, curly
    quotes do not, as Latin-1 is tried first."""
    curly = F.concat("text", F.lit(CURLY))
    docs = read(spark, sf, "documents").withColumn("kind", F.col("doc_id") % 3)
    original = F.when(F.col("kind") == 0, F.col("text")).otherwise(curly)
    shown = F.when(F.col("kind") == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).when(F.col("kind") == 2, F.translate(F.decode(F.encode(curly, "UTF-8"), "ISO-8859-1"), *CP1252)).otherwise(curly)
    docs = docs.select("doc_id", original.alias("original"), shown.alias("shown")).withColumn("repaired", unicode.repair("shown"))
    return docs.select("doc_id", unicode.count_markers("shown").alias("markers"), (F.col("repaired") == F.col("shown")).alias("untouched"), (F.col("repaired") == F.col("original")).alias("restored"))


IMAGE = r"!\[[^\]]*\]\(data:image/[^)]*\)|data:image/[A-Za-z+.-]+;base64,[A-Za-z0-9+/=]+"  # in a link, or bare
INJECTED_SQL = "html || CASE page_id % 3 WHEN 0 THEN chr(13) || chr(10) || '![x](data:image/png;base64,iVBORw0KGgo=)' WHEN 1 THEN ' data:image/gif;base64,R0lGODlh' || chr(10) || chr(10) || chr(10) || chr(10) ELSE '' END"


@query(
    f"""WITH h AS (SELECT page_id, {INJECTED_SQL} AS h FROM pages), a AS (SELECT page_id, h, regexp_replace(regexp_replace(h, '{IMAGE}', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS a FROM h),
    b AS (SELECT page_id, h, replace(replace(replace(a, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' ') AS b, a FROM a)
    SELECT page_id, CAST(len(regexp_extract_all(h, '{IMAGE}')) AS BIGINT) AS images, CAST(len(regexp_extract_all(regexp_replace(h, '{IMAGE}', '', 'g'), '(?s)<!--.*?-->')) AS BIGINT) AS comments, CAST(len(regexp_extract_all(a, chr(160))) AS BIGINT) AS hard_blanks, CAST(len(regexp_extract_all(a, chr(13))) AS BIGINT) AS returns, CAST(len(regexp_extract_all(b, '\n{{3,}}')) AS BIGINT) AS blank_runs,
    sha256(regexp_replace(regexp_replace(b, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') || chr(10)) AS text_sha256, regexp_replace(regexp_replace(b, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') || chr(10) <> h AS changed FROM b"""
)
def scl_09(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown cleaning with a counter for each kind of change: embedded images, comments, hard blanks, carriage returns, runs
    of blank lines. Images, returns and blank lines are injected."""
    kind = F.col("page_id") % 3
    injected = F.when(kind == 0, "\r\n![x](data:image/png;base64,iVBORw0KGgo=)").when(kind == 1, " data:image/gif;base64,R0lGODlh\n\n\n\n").otherwise("")
    pages = read(spark, sf, "pages").select("page_id", F.concat("html", injected).alias("h")).withColumn("i", F.regexp_replace("h", IMAGE, ""))
    pages = pages.withColumn("a", F.regexp_replace("i", r"(?s)<!--.*?-->", ""))
    pages = pages.withColumn("b", F.translate(F.replace("a", F.lit("\r\n"), F.lit("\n")), "\r\u00a0", "\n "))
    clean = F.concat(text.strip(F.regexp_replace("b", r"\n{3,}", "\n\n")), F.lit("\n"))
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("long")
    return pages.select(
        "page_id", count("h", IMAGE).alias("images"), count("i", r"(?s)<!--.*?-->").alias("comments"), count("a", "\u00a0").alias("hard_blanks"), count("a", "\r").alias("returns"), count("b", r"\n{3,}").alias("blank_runs"),
        F.sha2(clean, 256).alias("text_sha256"), (clean != F.col("h")).alias("changed"),
    )


#: Lines that are mended as they stand, in the files of one source: what is there, and what belongs there.
ANOMALIES = {"src0": (("## | odd", "odd"), ("## 2 **Heading O**", "## **Heading O2**")), "src1": (("## | odd", "| odd |"),)}
MARKED_SQL = "CASE i % 5 WHEN 1 THEN '## ' || CAST(i AS VARCHAR) || '.2 ' || line WHEN 2 THEN '## | ' || line WHEN 3 THEN '## | odd' WHEN 4 THEN '## 2 **Heading O**' ELSE line END"
ANOMALY_SQL = "CASE " + " ".join(f"WHEN source = '{f}' AND trim(line) = '{a}' THEN '{b}'" for f, pairs in ANOMALIES.items() for a, b in pairs) + " END"


@query(
    f"""WITH l AS (SELECT doc_id, source, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents)),
    h AS (SELECT doc_id, source, i, {MARKED_SQL} AS line FROM l), a AS (SELECT *, {ANOMALY_SQL} AS mended FROM h),
    k AS (SELECT *, CASE WHEN mended IS NOT NULL THEN 'anomaly' WHEN regexp_matches(line, '^##+ \\|') THEN 'table' WHEN regexp_matches(line, '^## (\\*\\*)?\\d{{1,2}}\\.\\d{{1,2}}\\b') THEN 'subsection' ELSE 'kept' END AS kind FROM a),
    r AS (SELECT *, CASE kind WHEN 'anomaly' THEN mended WHEN 'table' THEN regexp_replace(line, '^##+ ', '') WHEN 'subsection' THEN '#' || line ELSE line END AS fixed FROM k)
    SELECT doc_id, CAST(count(*) FILTER (WHERE kind = 'anomaly') AS INTEGER) AS anomalies, CAST(count(*) FILTER (WHERE kind = 'table') AS INTEGER) AS tables, CAST(count(*) FILTER (WHERE kind = 'subsection') AS INTEGER) AS subsections, sha256(string_agg(fixed, chr(10) ORDER BY i)) AS repaired_sha256 FROM r GROUP BY doc_id"""
)
def scl_10(spark: SparkSession, sf: str) -> DataFrame:
    """Heading repair per line: the map of known anomalies first, then table rows that became headings, then subsections one
    level down; the repaired text and how many lines of each kind changed. All in the row; odd lines are injected."""
    docs = read(spark, sf, "documents")

    def marked(line: F.Column, at: F.Column) -> F.Column:
        i = at + 1
        return F.when(i % 5 == 1, F.concat(F.lit("## "), i.cast("string"), F.lit(".2 "), line)).when(i % 5 == 2, F.concat(F.lit("## | "), line)).when(i % 5 == 3, "## | odd").when(i % 5 == 4, "## 2 **Heading O**").otherwise(line)

    def fixed(line: F.Column) -> F.Column:
        known = F.lit(None).cast("string")
        for source, pairs in ANOMALIES.items():
            for there, right in pairs:
                known = F.when((F.col("source") == source) & (F.trim(line) == there), right).otherwise(known)
        table, deep = line.rlike(r"^##+ \|"), line.rlike(r"^## (\*\*)?\d{1,2}\.\d{1,2}\b")
        kind = F.when(known.isNotNull(), "anomaly").when(table, "table").when(deep, "subsection").otherwise("kept")
        new = F.when(known.isNotNull(), known).when(table, F.regexp_replace(line, "^##+ ", "")).when(deep, F.concat(F.lit("#"), line)).otherwise(line)
        return F.struct(kind.alias("kind"), new.alias("line"))

    lines = docs.select("doc_id", "source", F.transform(F.split("text", "\n"), marked).alias("l")).select("doc_id", F.transform("l", fixed).alias("l"))
    count = lambda k: F.size(F.filter("l", lambda x: x["kind"] == k))
    return lines.select("doc_id", count("anomaly").alias("anomalies"), count("table").alias("tables"), count("subsection").alias("subsections"), F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 256).alias("repaired_sha256"))


@query(
    """WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
    c AS (SELECT line FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT l.*, c.line IS NOT NULL AS header FROM l LEFT JOIN c ON l.line = c.line),
    w AS (SELECT *, lag(header, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM m)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE i > 1 AND (header OR (after AND trim(line) = ''))) AS n_removed FROM w GROUP BY doc_id"""
)
def scl_11(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated header lines (found in three or more documents) and the blank line after one go, but not a first line."""
    from pyspark.sql.window import Window

    lines = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    common = lines.where(F.trim("line") != "").groupBy("line").agg(F.countDistinct("doc_id").alias("n")).where("n >= 3").select("line", F.lit(True).alias("header"))
    marked = lines.join(common, "line", "left").withColumn("header", F.coalesce("header", F.lit(False)))
    after = F.lag("header", 1, False).over(Window.partitionBy("doc_id").orderBy("p"))
    gone = (F.col("p") > 0) & (F.col("header") | (F.col("after") & (F.trim("line") == "")))
    return marked.withColumn("after", after).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(gone).alias("n_removed"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, '| ' || replace(line, ' ', ' | ') || ' | |' AS line FROM l)
    SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '\\|[^|]*\\|[^|]*\\|\\s*\\|')) AS collapsed, bool_or(regexp_matches(line, '^\\|(\\s*:?-+:?\\s*\\|)+$')) AS valid FROM t GROUP BY doc_id"""
)
def scl_12(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that hold a collapsed table, and whether a separator row makes it valid (table marks are injected)."""
    lines = read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    line = F.concat(F.lit("| "), F.replace("l", F.lit(" "), F.lit(" | ")), F.lit(" | |"))
    return lines.select("doc_id", line.alias("line")).groupBy("doc_id").agg(F.count_if(F.col("line").rlike(r"\|[^|]*\|[^|]*\|\s*\|")).alias("collapsed"), F.bool_or(F.col("line").rlike(r"^\|(\s*:?-+:?\s*\|)+$")).alias("valid"))


@query("SELECT doc_id, sha256(replace(replace(regexp_replace(regexp_replace('\\frac{1}{' || substr(text, 1, 40) || '} \\times $x$ ' || text, '\\\\frac\\{([^{}]*)\\}\\{([^{}]*)\\}', '(\\1)/(\\2)', 'g'), '\\$([^$]*)\\$', '\\1', 'g'), '\\times', '×'), '\\cdot', '·')) AS shown FROM documents")
def scl_13(spark: SparkSession, sf: str) -> DataFrame:
    """Formula marks made plain for display (marks are injected)."""
    t = F.concat(F.lit("\\frac{1}{"), F.substring("text", 1, 40), F.lit("} \\times $x$ "), "text")
    out = F.regexp_replace(F.regexp_replace(t, r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "($1)/($2)"), r"\$([^$]*)\$", "$1")
    out = F.replace(F.replace(out, F.lit("\\times"), F.lit("×")), F.lit("\\cdot"), F.lit("·"))
    return read(spark, sf, "documents").select("doc_id", F.sha2(out, 256).alias("shown"))


@query("SELECT conv_id, turn, sha256(trim(regexp_replace(regexp_replace('[[ctl:' || role || ']] ' || text || ' <tool>x</tool>', '\\[\\[ctl:[^\\]]*\\]\\]', '', 'g'), '(?s)<tool>.*?</tool>', '', 'g'))) AS clean FROM conversations")
def scl_14(spark: SparkSession, sf: str) -> DataFrame:
    """Control tags and internal artifacts out (they are injected)."""
    t = F.concat(F.lit("[[ctl:"), "role", F.lit("]] "), "text", F.lit(" <tool>x</tool>"))
    out = F.trim(F.regexp_replace(F.regexp_replace(t, r"\[\[ctl:[^\]]*\]\]", ""), r"(?s)<tool>.*?</tool>", ""))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.sha2(out, 256).alias("clean"))


#: Wording of answers that do not know, in the languages of the texts; openings that hedge; how a reservation begins.
ABSENT = r"not in the documents|keine angabe|pas trouv|no consta"
HEDGE = r"^(It seems that|Apparently,|Wohl|Il semble que)\s+"
CONCESSION = r"(^|[^\p{L}])(However|Jedoch|Cependant)[ ,]"
TAIL = r"(I could not find|Please check|Bitte pr)"
ANSWER_SQL = "CASE turn % 4 WHEN 0 THEN 'It seems that ' || text WHEN 1 THEN text || ' However, the rest is not in the documents.' WHEN 2 THEN 'However, ' || text ELSE text || ' Please check the label.' END"


@query(f"""WITH a AS (SELECT conv_id, turn, {ANSWER_SQL} AS t FROM conversations WHERE role = 'assistant'), b AS (SELECT *, trim(regexp_replace(trim(t), '{HEDGE}', '')) AS u FROM a),
  c AS (SELECT *, length(regexp_extract(u, '(?s)^(.*?)(?:{CONCESSION})', 1)) AS cut, regexp_matches(u, '{CONCESSION}') AS conceded FROM b),
  d AS (SELECT *, CASE WHEN conceded AND regexp_matches(lower(substr(u, cut + 1)), '{ABSENT}') THEN trim(substr(u, 1, cut)) ELSE u END AS v FROM c),
  e AS (SELECT *, trim(regexp_replace(regexp_replace(v, '(?s){TAIL}.*$', ''), '[;,:-]+\\s*$', '')) AS head FROM d)
  SELECT conv_id, turn, regexp_matches(lower(t), '{ABSENT}') OR trim(t) = '' AS uncertain, sha256(u) AS without_hedge, sha256(head) AS without_tail, CASE WHEN len(string_split(regexp_replace(head, '\\s+', ' ', 'g'), ' ')) >= 3 AND NOT regexp_matches(lower(head), '{ABSENT}') THEN sha256(head) END AS factual FROM e""")
def scl_15(spark: SparkSession, sf: str) -> DataFrame:
    """Uncertain answers: whether one says that it does not know; the text without a hedging opening; without a reservation
    (a concession only if what follows it is absent knowledge) or a closing referral; and the factual head, if what is left
    says something. Openings and tails are injected."""
    said = read(spark, sf, "conversations").where("role = 'assistant'")
    kind = F.col("turn") % 4
    t = F.when(kind == 0, F.concat(F.lit("It seems that "), "text")).when(kind == 1, F.concat("text", F.lit(" However, the rest is not in the documents."))).when(kind == 2, F.concat(F.lit("However, "), "text")).otherwise(F.concat("text", F.lit(" Please check the label.")))
    a = said.select("conv_id", "turn", t.alias("t")).withColumn("u", F.trim(F.regexp_replace(F.trim("t"), HEDGE, "")))
    before = F.length(F.regexp_extract("u", "(?s)^(.*?)(?:" + CONCESSION + ")", 1))
    concedes = F.col("u").rlike(CONCESSION) & F.lower(F.substring("u", before + 1, F.length("u"))).rlike(ABSENT)
    b = a.withColumn("v", F.when(concedes, F.trim(F.substring("u", F.lit(1), before))).otherwise(F.col("u")))
    b = b.withColumn("head", F.trim(F.regexp_replace(F.regexp_replace("v", "(?s)" + TAIL + ".*$", ""), r"[;,:-]+\s*$", "")))
    factual = (F.size(F.split(F.regexp_replace("head", r"\s+", " "), " ")) >= 3) & ~F.lower("head").rlike(ABSENT)
    return b.select("conv_id", "turn", (F.lower("t").rlike(ABSENT) | (F.trim("t") == "")).alias("uncertain"), F.sha2("u", 256).alias("without_hedge"), F.sha2("head", 256).alias("without_tail"), F.when(factual, F.sha2("head", 256)).alias("factual"))


#: What an answer should not say: how it may open, how its last paragraph or line may begin, and words for insiders.
OPENINGS, CLOSINGS, FOLLOWUPS, INTERNAL = "Certainly|Of course|Sure", "Disclaimer|In summary|Please note", "Let me know|Feel free", "internal tool"


@query(f"""WITH t AS (SELECT conv_id, turn, 'Certainly! ' || text || CASE turn % 3 WHEN 0 THEN chr(10) || chr(10) || 'In summary, all of it.' || chr(10) || 'Really.' WHEN 1 THEN chr(10) || chr(10) || 'Other words by an internal tool' ELSE '' END || chr(10) || 'Let me know if you need more.' AS t FROM conversations WHERE role = 'assistant'),
  a AS (SELECT *, trim(regexp_replace(regexp_replace(t, '^({OPENINGS})[!,.]?\\s*', ''), '\\n?({FOLLOWUPS})[^\\n]*$', '')) AS a FROM t), p AS (SELECT *, string_split_regex(a, '\\n\\s*\\n') AS p FROM a)
  SELECT conv_id, turn, sha256(trim(regexp_replace(CASE WHEN len(p) > 1 AND regexp_matches(p[-1], '^({CLOSINGS})') THEN array_to_string(p[:-2], chr(10) || chr(10)) ELSE array_to_string(p, chr(10) || chr(10)) END, '(?i){INTERNAL}', '', 'g'))) AS clean FROM p""")
def scl_16(spark: SparkSession, sf: str) -> DataFrame:
    """Banned phrases out: an opening courtesy, a last paragraph that disclaims or sums up (an only one stays), a closing
    offer, internal terms. They are injected."""
    extra = F.when(F.col("turn") % 3 == 0, "\n\nIn summary, all of it.\nReally.").when(F.col("turn") % 3 == 1, "\n\nOther words by an internal tool").otherwise("")
    t = F.concat(F.lit("Certainly! "), "text", extra, F.lit("\nLet me know if you need more."))
    a = F.trim(F.regexp_replace(F.regexp_replace(t, rf"^({OPENINGS})[!,.]?\s*", ""), rf"\n?({FOLLOWUPS})[^\n]*$", ""))
    said = read(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.split(a, r"\n\s*\n").alias("p"))
    closes = (F.size("p") > 1) & F.element_at("p", -1).rlike(f"^({CLOSINGS})")
    kept = F.array_join(F.when(closes, F.slice(F.col("p"), F.lit(1), F.size("p") - 1)).otherwise(F.col("p")), "\n\n")
    return said.select("conv_id", "turn", F.sha2(F.trim(F.regexp_replace(kept, f"(?i){INTERNAL}", "")), 256).alias("clean"))


#: Seventeen rules in order, eight kinds with "general"; the first that matches names the question. They fit the test
#: conversations, which are invented prose: they go by figures, signs, the first word, length and endings.
QUESTION_TYPES = (
    ("calculative", r"\d+[.,]?\d* ?[%€$]"),
    ("calculative", r"\d.*\d.*\d"),
    ("regulatory", r"(licen[cs]e|copyright)"),
    ("regulatory", r"@[a-z]+[0-9]*\."),
    ("factual_short", r"^[^ ]+( [^ ]+){0,3}$"),
    ("factual_short", r"^[^.]{1,40}\.$"),
    ("comparative", r"^(or|oder|ou|o) "),
    ("comparative", r" (than|als|que) [^.,]+, "),
    ("troubleshooting", r"(^| )(un|in|dé|des)[\p{L}]{9,}[.,]"),
    ("troubleshooting", r"[\p{L}]{18,}"),
    ("process", r"^(to|zu|pour|para) "),
    ("process", r"^[\p{L}]+(ing|en|ant|ando) "),
    ("process", r"\. (then|dann|puis|luego) "),
    ("enumerative", r"^[^.]*,[^.]*,[^.]*,[^.]*,"),
    ("enumerative", r"\. (and|und|et|y) "),
    ("factual_short", r"^(the|der|die|la|le|el) [^.]*\.$"),
    ("enumerative", r"(, [\p{L}]+){2}\."),
)


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in QUESTION_TYPES) + " ELSE 'general' END AS question_type FROM (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user')")
def scl_17(spark: SparkSession, sf: str) -> DataFrame:
    """Question type: the first rule that matches."""
    kind = F.lit("general")
    for name, pattern in reversed(QUESTION_TYPES):
        kind = F.when(F.col("t").rlike(pattern), name).otherwise(kind)
    asked = read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", text.collapse(F.lower("text")).alias("t"))
    return asked.select("conv_id", "turn", kind.alias("question_type"))


@query("SELECT conv_id, turn, CASE WHEN length(trim(text)) < 20 THEN 'unusable' WHEN len(regexp_extract_all(text, '\\d+\\s*[%a-zA-Z]')) >= 2 THEN 'high' WHEN len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) >= 25 THEN 'medium' ELSE 'low' END AS quality FROM conversations WHERE role = 'assistant'")
def scl_18(spark: SparkSession, sf: str) -> DataFrame:
    """Answer quality class."""
    n = F.size(F.split(text.collapse("text"), " "))
    kind = F.when(F.length(F.trim("text")) < 20, "unusable").when(F.regexp_count("text", F.lit(r"\d+\s*[%a-zA-Z]")) >= 2, "high").when(n >= 25, "medium").otherwise("low")
    return read(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", kind.alias("quality"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\d[\\d.,]*'), lambda g: regexp_replace(g, '[^\\d]', '', 'g')))), ' ') AS numbers FROM documents")
def scl_19(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric markers of a text, as a set."""
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(text.numbers("text")), " ").alias("numbers"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\n')) >= 12 AND length(text) / (len(regexp_extract_all(text, '\\n')) + 1) < 200 AS dump FROM documents")
def scl_20(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a text looks like pasted chunks: many short lines."""
    breaks = F.regexp_count("text", F.lit("\n"))
    return read(spark, sf, "documents").select("doc_id", ((breaks >= 12) & (F.length("text") / (breaks + 1) < 200)).alias("dump"))


@query("SELECT conv_id, turn, sha256(lower(" + COLLAPSE_SQL.format("text") + ")) AS query_hash FROM conversations")
def scl_21(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of a query in lower case and collapsed."""
    return read(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.lower(text.collapse("text")), 256).alias("query_hash"))


@query("SELECT event_id, round(0.0005 + 0.0008 + greatest(1, user_id % 5) * (1 + CAST(json_extract(props, '$.k') AS INTEGER) % 3) * 0.0015, 6) AS cost FROM events")
def scl_22(spark: SparkSession, sf: str) -> DataFrame:
    """Cost estimate of a routed call: agents by tries."""
    tries = F.get_json_object("props", "$.k").cast("int") % 3
    return read(spark, sf, "events").select("event_id", F.round(formulas.routing_cost(F.col("user_id") % 5, tries), 6).alias("cost"))


@query("SELECT event_id, least(greatest(value / 100, 0), 1) AS confidence, CASE WHEN least(greatest(value / 100, 0), 1) >= 0.86 THEN 'high' WHEN least(greatest(value / 100, 0), 1) >= 0.55 THEN 'medium' ELSE 'low' END AS bucket FROM events")
def scl_23(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence, clamped, and its bucket."""
    c = formulas.clamp(F.col("value") / 100)
    return read(spark, sf, "events").select("event_id", c.alias("confidence"), formulas.bucket(c).alias("bucket"))


@query(
    "SELECT conv_id, turn, upper(substr(t, 1, 1)) || substr(t, 2) AS title FROM (SELECT conv_id, turn, CASE WHEN length(s) <= 52 THEN s WHEN 52 - strpos(reverse(substr(s, 1, 52)), ' ') > 20 AND strpos(reverse(substr(s, 1, 52)), ' ') > 0 THEN substr(s, 1, 52 - strpos(reverse(substr(s, 1, 52)), ' ')) ELSE substr(s, 1, 52) END AS t FROM (SELECT conv_id, turn, regexp_replace(" + COLLAPSE_SQL.format("text") + ", '^(?i)(please|the|la|der) ', '') AS s FROM conversations WHERE role = 'user' AND length(trim(text)) > 8))"
)
def scl_24(spark: SparkSession, sf: str) -> DataFrame:
    """Thread title from a prompt: lead-in stripped, cut at a blank behind character 20, first letter raised."""
    said = read(spark, sf, "conversations").where("role = 'user' and length(trim(text)) > 8")
    s = F.regexp_replace(text.collapse("text"), r"^(?i)(please|the|la|der) ", "")
    said = said.select("conv_id", "turn", s.alias("s")).withColumn("back", F.instr(F.reverse(F.substring("s", 1, 52)), " "))
    t = F.when(F.length("s") <= 52, F.col("s")).when((F.col("back") > 0) & (52 - F.col("back") > 20), F.expr("substring(s, 1, 52 - back)")).otherwise(F.substring("s", 1, 52))
    return said.select("conv_id", "turn", t.alias("t")).select("conv_id", "turn", F.concat(text.capital(F.substring("t", 1, 1)), F.expr("substring(t, 2)")).alias("title"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN rtrim(substr(text, 1, 57), ' ') || '...' ELSE text END AS short, string_split(text, '. ')[1] AS segment, concat_ws(' | ', role, substr(text, 1, 20)) AS search FROM conversations")
def scl_25(spark: SparkSession, sf: str) -> DataFrame:
    """Cutting with an ellipsis, the segment before a marker, and a contextual query."""
    return read(spark, sf, "conversations").select("conv_id", "turn", text.cut("text", 60).alias("short"), F.split_part("text", F.lit(". "), F.lit(1)).alias("segment"), F.concat_ws(" | ", "role", F.substring("text", 1, 20)).alias("search"))


@query("SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS BIGINT) AS into_day_us FROM events")
def scl_26(spark: SparkSession, sf: str) -> DataFrame:
    """Day, ISO form and microseconds into the day, in UTC."""
    day = F.date_trunc("day", "ts")
    return read(spark, sf, "events").select("event_id", F.date_format(day, "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(day.cast("timestamp"))).alias("into_day_us"))


#: Documents with objects and arrays in each other, made of an event; and patterns that some of them contain.
NESTED_PATTERNS = ({"k": 10}, {"kind": {"type": "click"}}, {"tags": [1, "a"]}, {"tags": [{"user": {"odd": True}}], "none": None}, {"kind": {"type": "click", "list": [[2], []]}}, {})


@query(
    """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type = 'click' AS click, user_id % 3 AS t, user_id % 2 = 1 AS odd, event_id % 5 = 0 AS broken,
      '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS built FROM events)
    SELECT event_id, k, built, CASE WHEN broken THEN '' ELSE concat_ws(',', CASE WHEN k = 10 THEN '0' END, CASE WHEN click THEN '1' END, CASE WHEN t = 1 THEN '2' END, CASE WHEN odd THEN '3' END, CASE WHEN click AND t = 2 THEN '4' END, '5') END AS matches FROM e WHERE k >= 10"""
)
def scl_27(spark: SparkSession, sf: str) -> DataFrame:
    """JSON: field access, filtering on a field, building, and which of six patterns a nested document contains; every fifth
    document is broken and contains none."""
    e = read(spark, sf, "events").withColumn("doc", documents.parsed("props")).withColumn("k", documents.field(F.col("doc"), "$.k", "bigint")).where("k >= 10")
    built = F.to_json(F.struct("k", F.col("event_type").alias("type")))
    t = F.col("user_id") % 3
    tags = F.concat(F.lit('["a", '), t.cast("string"), F.lit(', {"user": {"odd": '), (F.col("user_id") % 2 == 1).cast("string"), F.lit("}}]"))
    nested = F.concat(F.lit('{"k": '), F.col("k").cast("string"), F.lit('.0, "kind": {"type": "'), "event_type", F.lit('", "list": [[], [7, '), t.cast("string"), F.lit(']]}, "none": null, "tags": '), tags, F.when(F.col("event_id") % 5 == 0, "]").otherwise("}"))
    e = e.select("event_id", "k", built.alias("built"), nested.alias("raw")).withColumn("doc", documents.parsed("raw"))
    hits = [F.when(documents.may_contain(F.col("raw"), p) & documents.contains(F.col("doc"), p), str(i)) for i, p in enumerate(NESTED_PATTERNS)]
    return e.select("event_id", "k", "built", F.concat_ws(",", *hits).alias("matches"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6))) AS total FROM embeddings")
def scl_28(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors at the six decimals of their text form."""
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 6))
    return read(spark, sf, "embeddings").select("vec_id", F.aggregate(rounded, F.lit(0.0), lambda a, x: a + x).alias("total"))


#: Inputs of the formulas from the columns of lineitem; some are out of range, missing or no number.
INPUTS = {
    "F": "l_quantity / 10", "C": "CASE WHEN l_linenumber <> 6 THEN l_discount * 30 END", "W": "l_discount * 11", "FRF": "0.9 - l_tax", "PTN": "3 + l_tax", "PC": "0.7 + l_discount", "FT": "1.0 - l_tax / 2",
    "D15": "CASE WHEN l_linenumber = 5 THEN 0.0 ELSE 1 + l_tax / 2 END", "RVS": "l_quantity - 2", "L15": "CASE WHEN l_linenumber = 4 AND l_tax = 0 THEN CAST('NaN' AS DOUBLE) ELSE 1000 * l_tax END", "L20": "30 + l_discount", "D": "1 + l_tax / 3", "RFF": "CASE WHEN l_quantity < 3 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(l_quantity AS DOUBLE) END",
}
KIND = "CASE l_returnflag WHEN 'A' THEN 'Filados ' WHEN 'N' THEN CASE WHEN l_linenumber = 3 THEN '1.25' ELSE 'duros' END ELSE CASE WHEN l_linenumber = 1 THEN 'gouda' WHEN l_linenumber > 1 THEN 'massa_mole' END END"
_IN = {k: f"CAST({v} AS DOUBLE)" for k, v in INPUTS.items()}
_FORMULA_SQL = {
    "van_slyke_original": ("F C W", "(0.93::DOUBLE * F + C - 0.1::DOUBLE) * 1.09::DOUBLE / (1 - W)", "W < 0 OR W >= 1", "W must be at least 0 and below 1"),
    "van_slyke_otimizada": ("FRF F PTN PC FT FC W", "(FRF * F + PTN * PC * FT * FC) / (1 - W)", "W < 0 OR W >= 1", "W must be at least 0 and below 1"),
    "van_slyke_lkg": ("D15 RVS", "100 / D15 / RVS", "D15 <= 0 OR RVS <= 0", None),
    "fleischmann": ("F D15", "1.2::DOUBLE * F + 266.5::DOUBLE * (D15 - 1) / D15 + 0.25::DOUBLE", "D15 <= 0", "D15 must be above 0"),
    "furtado": ("F L15", "1.2::DOUBLE * F + 0.25::DOUBLE * L15 + 0.25::DOUBLE", "false", ""),
    "esd_fleischmann_furtado": ("RFF F", "RFF - F", "false", ""),
    "richmond_f1": ("L15 F", "L15 / 4 + 1.2::DOUBLE * F + 0.14::DOUBLE", "false", ""),
    "richmond_f2": ("L20 F", "L20 / 4 + 1.2::DOUBLE * F + 0.50::DOUBLE", "false", ""),
    "richmond_f3": ("L15 F", "L15 / 4 + 0.2::DOUBLE * F + 0.14::DOUBLE", "false", ""),
    "richmond_f4": ("L20 F", "L20 / 4 + 0.2::DOUBLE * F + 0.50::DOUBLE", "false", ""),
    "densidade_para_graus_lactometricos": ("D", "(D - 1) * 1000", "false", ""),
    "furtado_soro": ("F L15", "1.2::DOUBLE * F + L15 / 4.33::DOUBLE + 0.25::DOUBLE", "false", ""),
}


def _formula_sql(name: str, keys: str, value: str, bad: str, said: str | None) -> str:
    own = keys.split()
    rest = [k for k in own if k != "FC"]
    gaps = f"list_filter([{', '.join(f'CASE WHEN {k} IS NULL THEN {k!r} END' for k in rest)}], lambda x: x IS NOT NULL)"
    odd = f"list_filter([{', '.join(f'CASE WHEN NOT isfinite({k}) THEN {k!r} END' for k in own)}], lambda x: x IS NOT NULL)"
    kind = "WHEN kind IS NULL THEN 'missing: FC' WHEN FC IS NULL THEN 'unknown kind' " if "FC" in own else ""
    said = "CASE WHEN D15 <= 0 THEN 'D15 must be above 0' ELSE 'RVS must be above 0' END" if said is None else f"'{said}'"
    fault = f"CASE WHEN len({gaps}) > 0 THEN 'missing: ' || array_to_string({gaps}, ', ') {kind}WHEN len({odd}) > 0 THEN 'not finite: ' || array_to_string({odd}, ', ') WHEN {bad} THEN {said} END"
    return f"SELECT l_orderkey, l_linenumber, '{name}' AS formula, {fault} AS error, CASE WHEN {fault} IS NULL THEN round({value}, 4) END AS result FROM n"


FORMULAS_SQL = f"""WITH n AS (SELECT *, CASE lower(trim(kind)) {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in formulas.FACTORS.items())} ELSE try_cast(kind AS DOUBLE) END AS FC
  FROM (SELECT l_orderkey, l_linenumber, {', '.join(f"{v} AS {k}" for k, v in _IN.items())}, {KIND} AS kind FROM lineitem)),
  formulas AS ({' UNION ALL '.join(_formula_sql(n, *x) for n, x in _FORMULA_SQL.items())} UNION ALL SELECT l_orderkey, l_linenumber, 'no_such_formula', 'unknown formula', NULL FROM n)"""


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """Every formula, and one that does not exist, over every row of lineitem: result and error."""
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(v).alias(k) for k, v in _IN.items()], F.expr(KIND).alias("kind"))
    inputs = {k: F.col(k) for k in INPUTS}
    # A formula that is known beforehand is one small generated loop; chosen by row, each row goes through all of them.
    made = [rows.select("l_orderkey", "l_linenumber", F.lit(name).alias("formula"), formulas.compute(name, inputs, F.col("kind")).alias("r")) for name in (*formulas.CATALOGUE, "no_such_formula")]
    return reduce(DataFrame.unionByName, made).select("l_orderkey", "l_linenumber", "formula", "r.result", "r.error")


@query(FORMULAS_SQL + " SELECT l_orderkey, l_linenumber, formula, round(result + 1e-9, 3) AS result, error FROM formulas")
def scl_29(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve named formulas over measurement rows, with what is wrong where there is no result."""
    return measured(spark, sf).withColumn("result", F.round(F.col("result") + 1e-9, 3))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(l_tax * l_quantity / l_discount, 4) END AS v2, CASE WHEN l_extendedprice > 0 THEN round(100 * l_quantity / l_extendedprice, 4) END AS percent FROM lineitem")
def scl_30(spark: SparkSession, sf: str) -> DataFrame:
    """Dilution C1 V1 = C2 V2 solved for V2, and percent yield, both guarded."""
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(formulas.dilution(F.col("l_tax"), F.col("l_quantity"), F.col("l_discount")), 4).alias("v2"), F.round(formulas.percent(F.col("l_quantity"), F.col("l_extendedprice")), 4).alias("percent"))
