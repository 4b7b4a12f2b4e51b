"""The queries op1 to op10 and pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, language_id, line_dedup, mixing, ngram_join, pii, quality_rules, toxicity, warc
from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets have a Jaccard similarity of 0.8 at least."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by pattern, and terms that give protected entities away."""
    return pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that are part of benchmark windows."""
    out = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.drop("spans")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by cross-parsing."""
    return language_id.language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of repeated runs of lines."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back from it."""
    return warc.read_archive(warc.write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))).drop("url")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix to target weights takes, and into which shards."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.withColumn("draws", mixing.draws_text(F.col("draws")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return quality_rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_pii, op3_decontamination, op4_language_id, op5_line_dedup, op6_warc, op7_mixing, op8_quality_rules, op9_html_extraction, op10_toxicity)
}

_OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.i >= 80 * (na.n + nb.n - p.i)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.r) AS component_id
FROM documents d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

_OP3_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS x(i) WHERE len(ws) > 0
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), dw AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM d, (SELECT DISTINCT m FROM bw), unnest(range(1, len(ws) - m + 2)) AS x(i) WHERE len(ws) >= m
), h AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON bw.m = dw.m AND bw.g = dw.g),
w AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + m)) AS x(p) GROUP BY 1),
t AS (SELECT doc_id, count(k) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN w USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP5_SQL = line_dedup.REPEATED_SQL.format(documents="documents") + r"""
SELECT d.doc_id, CASE WHEN g.lines IS NULL THEN d.text ELSE coalesce(array_to_string([p FOR p, i IN string_split(d.text, chr(10)) IF NOT list_contains(g.lines, i - 1)], chr(10)), '') END AS text,
  CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(len(g.lines), 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN gone g USING (doc_id)
"""

_OP6_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
x AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY sha1(b)) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(('0x' || substr(h, 5 * (j // 4) + 1, 5)) AS BIGINT) >> (15 - 5 * (j % 4))) & 31 AS INTEGER) + 1, 1) FOR j IN range(32)], '') AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM x
"""

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": _OP1_SQL,
    "op3_decontamination": _OP3_SQL,
    "op5_line_dedup": _OP5_SQL,
    "op6_warc": _OP6_SQL,
    "op7_mixing": mixing.mixing_sql("documents"),
}
