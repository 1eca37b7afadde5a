"""Queries opN_<name>: each operator with production parameters over its whole table, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, language_id, line_dedup, mixing, near_dedup, ngram_lm, quality_rules, sentencepieces, substring_dedup, topk_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score_quality(_table(spark, sf_dir, "documents"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0, k=10)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), length=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.encode_documents(docs, keep=["doc_id"])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op4_ngram_lm": op4_ngram_lm,
    "op5_topk_search": op5_topk_search,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mixing": op8_mixing,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_id": op10_language_id,
}

_SPACES = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT doc_id, place, line, coalesce(source, chr(0)) AS site, trim(line, {_SPACES}) AS key FROM lines),
common AS (
  SELECT key, min((doc_id, place)) AS first FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= 5),
marked AS (
  SELECT k.doc_id, k.place, k.line, c.key IS NOT NULL AND (k.doc_id, k.place) <> c.first AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key),
cleaned AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
       c.text AS text
FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id""",
    "op8_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest
  FROM documents),
sized AS (
  SELECT *, length(bin(size)) AS b,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM docs),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER rising, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER rising, 0))::DOUBLE AS level
  FROM per
  WINDOW rising AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rest AS (
  SELECT arg_min(level, (cap::DOUBLE / weight, source)) AS level FROM levels WHERE NOT level * weight > cap),
targets AS (
  SELECT l.source, l.source_size, CASE WHEN l.level * l.weight > l.cap THEN l.cap::DOUBLE ELSE r.level * l.weight END AS target
  FROM levels l, rest r),
classes AS (
  SELECT t.source, t.source_size, t.target, d.b, CAST(sum(d.size) AS BIGINT) AS s
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
shared AS (
  SELECT *, coalesce(sum(s) OVER (PARTITION BY source ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
         sum(s * b) OVER (PARTITION BY source ORDER BY b DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below
  FROM classes),
fitted AS (
  SELECT *, CASE WHEN below > 0 THEN (target - (3 * above)::DOUBLE) / below::DOUBLE END AS level FROM shared),
chosen AS (
  SELECT source, arg_max(level, b) AS c FROM fitted WHERE s > 0 AND level * b <= 3 GROUP BY source),
expected AS (
  SELECT f.*, CASE WHEN source_size = 0 THEN 0::DOUBLE WHEN c IS NULL OR c * b > 3 THEN 3::DOUBLE ELSE c * b END AS m
  FROM fitted f LEFT JOIN chosen c ON f.source IS NOT DISTINCT FROM c.source),
plan AS (
  SELECT source, b, source_size, target, CAST(floor(m) AS BIGINT) AS whole, m - floor(m) AS p,
         target - (sum(s * CAST(floor(m) AS BIGINT)) OVER (PARTITION BY source))::DOUBLE AS remain
  FROM expected),
odds AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.p, p.remain, CASE WHEN p.p > 0 THEN (d.u / (1 - d.u)) / (p.p / (1 - p.p)) END AS q
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source AND d.b = p.b),
ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN q / (1 + q) ELSE 2 END, doc_id, size ROWS UNBOUNDED PRECEDING) AS until FROM odds)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN p > 0 AND remain > 0 AND (until <= remain OR 2 * remain > 2 * until - size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked""",
}
