"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, html_extract, language_id, lm_score, packing, quality_classifier, quality_rules, sharding, simhash_dedup
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(table(spark, sf_dir, "conversations"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade's verdicts; the counts that the result also lists are made beside it."""
    told = quality_rules.cascade(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality_rules.with_statistics(told).select("doc_id", *quality_rules.STATISTICS, "base_failed", "kept")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    ops = (op1_html_extract, op2_lm_score, op3_chat_format, op4_quality_classifier, op5_sharding, op6_decontamination, op7_packing, op8_quality_rules, op9_language_id, op10_simhash_dedup)
    return {f.__name__: f for f in ops}


_RULES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
lines AS (
  SELECT k, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT k, unnest(ls) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY k),
windows AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, w) AS n
  FROM (SELECT k, i, array_to_string(ws[i:i + 2], ' ') AS w FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM d))),
covered AS (
  SELECT k, count(DISTINCT i + o) AS n FROM windows, (VALUES (0), (1), (2)) AS offsets(o) WHERE n > 1 GROUP BY k),
s AS (
  SELECT d.doc_id, d.t, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS capitals, len(ls) AS n_lines
  FROM d LEFT JOIN lines USING (k) LEFT JOIN covered USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols * 10 > word_chars OR n_dup_lines * 2 > n_lines
    OR capitals * 2 > word_chars OR word_chars > n_words * 20 OR word_chars < n_words * 2) AS kept
FROM s
"""


def oracle_sql() -> dict[str, str]:
    """Only the rules' counts and verdicts are plain SQL; the others are tested against brute force."""
    return {"op8_quality_rules": _RULES_SQL}
