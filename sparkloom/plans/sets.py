"""Set operations and de-duplication over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.dedup import first_per, not_contained, unique_paragraphs
from .base import query, read
from .filters import SEARCHED_SQL, searched
from .scalars import FOLD_SQL, ODD_COMPOSED, with_odd


@query(
    r"""WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text || CASE WHEN doc_id % 3 = 0 THEN '"""
    + ODD_COMPOSED
    + r"""' ELSE '' END, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents)
    SELECT min(doc_id) AS doc_id, count(*) AS copies FROM n GROUP BY sha256(regexp_replace(t, '^\s+|\s+$', '', 'g'))"""
)
def set_01(spark: SparkSession, sf: str) -> DataFrame:
    """Exact document dedup on the hash of the text in NFKC with plain line ends and blanks (odd characters are injected)."""
    return with_odd(spark, sf).groupBy(F.sha2(text.canonical("text"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("SELECT substr(sha256(text), 1, 16) AS content_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY content_hash")
def set_02(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk dedup by hash prefix."""
    return read(spark, sf, "documents").groupBy(F.substring(F.sha2("text", 256), 1, 16).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY substr(text, 1, 200)")
def set_03(spark: SparkSession, sf: str) -> DataFrame:
    """Results that begin alike: the first stays, blank ones go."""
    docs = read(spark, sf, "documents").where("trim(text) <> ''").select("doc_id", F.substring("text", 1, 200).alias("head"))
    return first_per(docs, F.col("head"), F.col("doc_id")).select("doc_id")


@query("WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), k AS (SELECT doc_id, i, line, " + FOLD_SQL.format("line") + " AS k FROM l), f AS (SELECT doc_id, min(i) AS i, arg_min(line, i) AS line FROM k WHERE k <> '' GROUP BY doc_id, k) SELECT d.doc_id, sha256(coalesce(string_agg(f.line, chr(10) ORDER BY f.i), '')) AS kept FROM documents AS d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id")
def set_04(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraph dedup inside a text."""
    return read(spark, sf, "documents").select("doc_id", F.sha2(unique_paragraphs("text"), 256).alias("kept"))


@query()
def set_05(spark: SparkSession, sf: str) -> DataFrame:
    """Containment dedup of a text's sentences, longest first, five at most (tested against a loop)."""
    s = F.filter(text.sentences("text"), lambda x: F.length(x) >= 18)
    order = F.transform(F.array_sort(F.transform(F.array_distinct(s), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("s")))), lambda x: x["s"])
    return read(spark, sf, "documents").select("doc_id", not_contained(order, 5).alias("kept"))


@query("WITH " + SEARCHED_SQL.format(k=8) + " SELECT query_id, vec_id, 'odd' AS source_table FROM hits WHERE label % 2 = 1 UNION ALL SELECT query_id, vec_id, 'even' FROM hits WHERE label % 2 = 0")
def set_06(spark: SparkSession, sf: str) -> DataFrame:
    """Result lists of two domains, tagged and put together."""
    labels = read(spark, sf, "embeddings").select("vec_id", "label")
    hits = searched(spark, sf).join(labels, "vec_id")
    parts = [hits.where(F.col("label") % 2 == r).select("query_id", "vec_id", F.lit(n).alias("source_table")) for r, n in ((1, "odd"), (0, "even"))]
    return parts[0].unionByName(parts[1])


@query("SELECT user_id, arg_max(event_id, struct_pack(ok := event_type <> 'error', v := CASE WHEN event_type <> 'error' THEN event_id ELSE -event_id END)) AS event_id FROM events GROUP BY user_id")
def set_07(spark: SparkSession, sf: str) -> DataFrame:
    """Response merge: the latest success, else the earliest failure."""
    ok = F.col("event_type") != "error"
    return read(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(ok, F.when(ok, F.col("event_id")).otherwise(-F.col("event_id")))).alias("event_id"))


@query("SELECT event_id, array_to_string(list_filter(list_transform(l, lambda x: try_cast(x AS INTEGER)), lambda x, i: x IS NOT NULL AND list_position(list_transform(l, lambda y: try_cast(y AS INTEGER)), x) = i), ',') AS ids FROM (SELECT event_id, string_split(user_id || ',' || event_type || ',' || json_extract_string(props, '$.k') || ',' || user_id, ',') AS l FROM events)")
def set_08(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered distinct of an id list; what is not a number goes."""
    raw = F.split(F.concat_ws(",", F.col("user_id").cast("string"), "event_type", F.get_json_object("props", "$.k"), F.col("user_id").cast("string")), ",")
    ids = F.array_distinct(F.filter(F.transform(raw, lambda x: x.try_cast("int")), lambda x: x.isNotNull()))
    return read(spark, sf, "events").select("event_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))
