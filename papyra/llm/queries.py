"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import byte_bpe, language_id, line_dedup, media_columns, ngram_join, packing, suffix_dedup, url_filters, vector_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)


OP1_SQL = """
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents
), x AS (
  SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line FROM l
), w AS (
  SELECT doc_id, i, len(trim(line)) = 0 AS blank, CASE WHEN trim(line) = '' THEN '' ELSE line END AS line,
         lead(CASE WHEN trim(line) = '' THEN '' ELSE line END, 1) OVER d AS line2, lead(CASE WHEN trim(line) = '' THEN '' ELSE line END, 2) OVER d AS line3
  FROM x WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), f AS (
  SELECT *, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, i) AS nth
  FROM w WHERE line3 IS NOT NULL AND line || line2 || line3 <> ''
), gone AS (
  SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM f WHERE nth > 1
), kept AS (
  SELECT x.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(x.line, chr(10) ORDER BY x.i) FILTER (WHERE g.i IS NULL), '') AS kept
  FROM x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id
)
SELECT doc_id, n_lines, n_removed, kept FROM kept
"""


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media_columns.text_media(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n_bytes",
        "media.payload_bytes",
        F.lower(F.hex("media.payload_sha256")).alias("payload_sha256"),
        "media.tail_crc32",
        "media.media_bytes",
        F.lower(F.hex("media.media_sha256")).alias("media_sha256"),
        "media.feature",
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(manifest, payloads=False).select(
        F.col("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"
    )


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages
), d AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha, min(page_id) OVER (PARTITION BY body) AS first FROM p
), b AS (
  SELECT page_id, payload_bytes, first,
         [('0x' || substr(sha, i, 5))::BIGINT FOR i IN range(1, 40, 5)] AS words
  FROM d
)
SELECT page_id, payload_bytes,
       list_aggregate(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((w >> s) & 31) + 1)::BIGINT, 1) FOR s IN [15, 10, 5, 0]] FOR w IN words]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a
  FROM documents
), g AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(a[i : i + 4], ' ') AS gram
  FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 4, 1) + 1)) AS i FROM w WHERE len(a) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), reach(a, b) AS (
  SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b
), c AS (
  SELECT a, least(a, min(b)) AS least FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP7_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), u AS MATERIALIZED (
  SELECT vec_id, label, e, sqrt(list_sum([x * x FOR x IN e])) AS norm FROM v
  WHERE label IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_sum([x * x FOR x IN e]) > 0
), l AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b
), k AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
), c AS (
  SELECT a, least(a, min(b)) AS least FROM reach GROUP BY a
)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, coalesce(c.least, v.vec_id) AS component_id, coalesce(c.least, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN k ON k.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)


OP9_SQL = r"""
WITH t AS MATERIALIZED (
  SELECT doc_id, encode(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents
), s AS (
  SELECT doc_id, i, h[i + 1 : i + 50] AS piece FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM t WHERE n >= 50)
), f AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY piece) AS first FROM s
), m AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f WHERE first < doc_id
), e AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m
), r AS (
  SELECT doc_id, run, min(i) AS low, max(i) + 50 AS high FROM e GROUP BY doc_id, run
), x AS (
  SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS since FROM r
), k AS (
  SELECT x.doc_id, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last, string_agg(hex(h[since + 1 : low]), '' ORDER BY low) AS kept
  FROM x JOIN t ON t.doc_id = x.doc_id GROUP BY x.doc_id
)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || hex(h[coalesce(last, 0) + 1 : n]))) AS kept_sha256
FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filters.rule_table(spark))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.rule_verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS nth
  FROM p LEFT JOIN r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE nth = 1
"""

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc": op4_warc,
    "op5_ngram_join": op5_ngram_join,
    "op6_packing": op6_packing,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_filters": op10_url_filters,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op4_warc": OP4_SQL,
    "op5_ngram_join": OP5_SQL,
    "op7_vector_dedup": OP7_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op10_url_filters": OP10_SQL,
}
