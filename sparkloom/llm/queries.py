"""The registered queries of this package: each applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_stream, embedding_dedup, knn_join, line_dedup, mixing, ngram_join, source_audit, substring_dedup, suffix_dedup, token_counts, token_files, toxicity, vector_codes
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left when 100-byte strings that also start earlier are gone."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100).drop("spans")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors by cosine of 0.95 or more."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, written and read back."""
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source, with shards and places of the draws."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"), F.col("draws.place").alias("places"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", F.round("severity", 6).alias("severity"), "grade", "toxic")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best rows for every twentieth vector, by integer inner product."""
    return knn_join.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document."""
    return bpe_stream.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines found in ten documents or more."""
    lines = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by Jaccard similarity of 0.9 or more of their 3-word shingles."""
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left when repeated windows of 35 words are gone."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=35).drop("spans")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of each lang, and each source's ten most divergent terms."""
    return source_audit.audit(table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors after two rounds over the codebooks."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), scale=256, rounds=2)


OP9_SQL = r"""
WITH pieces AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), lines AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM pieces
), frequent AS (
  SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent AS f ON lines.k = f.k GROUP BY doc_id
"""

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached AS r JOIN links AS l ON r.b = l.a
), parts AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
), degrees AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT p.vec_id, coalesce(n, 0) AS n_links, component_id, p.vec_id = component_id AS kept
FROM parts AS p LEFT JOIN degrees AS d ON p.vec_id = d.vec_id
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
         ELSE list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i:i + 2], ' ')) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached AS r JOIN links AS l ON r.b = l.a
)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM reached AS r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents
), words AS (
  SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i, len(l) AS n FROM w WHERE len(l) > 0
), windows AS (
  SELECT doc_id, i, word, CASE WHEN i + 34 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS g
  FROM words
), repeated AS (
  SELECT g FROM windows WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1
), flagged AS (
  SELECT doc_id, i, word, CASE WHEN r.g IS NULL THEN 0 ELSE 1 END AS f FROM windows AS w LEFT JOIN repeated AS r ON w.g = r.g
), covered AS (
  SELECT doc_id, i, word, max(f) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM flagged
), kept AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS t FROM covered GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents AS d LEFT JOIN kept AS k ON d.doc_id = k.doc_id
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS l
  FROM documents
), t AS (
  SELECT r, lang, source, unnest(l) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), counts AS (
  SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN kept AS k ON t.lang = k.lang AND t.term = k.term GROUP BY 1, 2, 3
), totals AS (
  SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source
), groups AS (
  SELECT g.lang, g.source, coalesce(s.total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) AS g
  LEFT JOIN totals AS s ON g.lang = s.lang AND g.source = s.source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * a.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (a.total + 2 * a.v) AS q
  FROM groups AS g JOIN kept AS k ON g.lang = k.lang JOIN langs AS a ON g.lang = a.lang
  LEFT JOIN counts AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM shares AS x JOIN shares AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3
), both_parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups AS g JOIN groups AS h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN sums AS s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM both_parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_ASSIGN = """
a{0} AS (
  SELECT vec_id, p, arg_min(e, far) AS e, min(far) AS far, any_value(x) AS x FROM (
    SELECT vec_id, p, x, struct_pack(e := b.e) AS e, (list_sum(list_transform(generate_series(1, len(x)), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT, b.e) AS far
    FROM parts JOIN b{0} AS b USING (p)
  ) GROUP BY vec_id, p
)"""
_REFINE = """,
s{0} AS (
  SELECT p, a.e.e AS e, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{0} AS a, generate_series(1, (SELECT max(len(x)) FROM parts)) AS g(i) GROUP BY 1, 2, 3
), m{0} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c FROM s{0} GROUP BY p, e
), b{1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{0} AS b LEFT JOIN m{0} AS m ON b.p = m.p AND b.e = m.e
), """
OP13_SQL = (
    """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(256 * x) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] AS x FROM v, generate_series(0, 15) AS g(p)
), b0 AS (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)
),"""
    + _ASSIGN.format(0)
    + _REFINE.format(0, 1)
    + _ASSIGN.format(1)
    + _REFINE.format(1, 2)
    + _ASSIGN.format(2)
    + """, coded AS (
  SELECT vec_id, string_agg(printf('%02x', e.e), '' ORDER BY p) AS code, CAST(sum(far[1]) AS BIGINT) AS error FROM a2 GROUP BY vec_id
), rows AS (
  SELECT c.vec_id, code, error, label FROM coded AS c JOIN v ON c.vec_id = v.vec_id
), flat AS (
  SELECT p, e, i, c[i] AS x FROM b2, generate_series(1, (SELECT max(len(c)) FROM b2)) AS g(i)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM flat) AS codebooks_sha256
FROM rows
"""
)

QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_embedding_dedup, op3_token_files, op4_token_counts, op5_source_mix, op6_toxicity, op7_top_k, op8_bpe_stream, op9_line_dedup, op10_ngram_join, op11_substring_dedup, op12_source_audit, op13_vector_codes)
}
ORACLES = {"op2_embedding_dedup": OP2_SQL, "op7_top_k": OP7_SQL, "op9_line_dedup": OP9_SQL, "op10_ngram_join": OP10_SQL, "op11_substring_dedup": OP11_SQL, "op12_source_audit": OP12_SQL, "op13_vector_codes": OP13_SQL}
