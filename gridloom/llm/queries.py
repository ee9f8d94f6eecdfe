"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import leakage, mixing, overlap, packing, personal, proportions
from gridloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.found_pairs(overlap.cross_split_pairs(table(spark, folder, "manifest"), table(spark, folder, "apps")))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(table(spark, folder, "manifest"), table(spark, folder, "apps"))


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    return packing.record_lengths(table(spark, folder, "annotations"), table(spark, folder, "images"))


def p2_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every record, or of each piece of a record longer than its container."""
    return packing.packed(_lengths(spark, folder), table(spark, folder, "recipe"))


def p2_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p2_packed(spark, folder), table(spark, folder, "recipe"))


def p2_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return _lengths(spark, folder)


P2_LENGTHS = """
WITH last AS (
  SELECT record_id, dataset, conversations, image, image_list FROM annotations WHERE record_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC NULLS LAST) = 1),
sizes AS (
  SELECT image, max(CASE WHEN width > 0 AND height > 0 THEN ceil(width / 28.0) * ceil(height / 28.0) ELSE 0 END)::BIGINT AS cells FROM images GROUP BY image),
uses AS (SELECT record_id, unnest(CASE WHEN image IS NOT NULL THEN [image] ELSE coalesce(image_list, []) END) AS image FROM last),
per_record AS (SELECT record_id, sum(cells)::BIGINT AS cells FROM uses JOIN sizes USING (image) WHERE image <> '' GROUP BY record_id)
SELECT record_id, dataset,
  ceil(coalesce(list_sum(list_transform(conversations, lambda t: coalesce(length(t.value), 0))), 0) / 4.0)::BIGINT + coalesce(cells, 0) AS tokens
FROM last LEFT JOIN per_record USING (record_id)
"""


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    return proportions.proportional_sample(table(spark, folder, "manifest"), table(spark, folder, "label_targets"))[0]


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """The targets with what was reached and why some were not met."""
    return proportions.proportional_sample(table(spark, folder, "manifest"), table(spark, folder, "label_targets"))[1]


def p4_categories(spark: SparkSession, folder: str) -> DataFrame:
    return proportions.category_counts(proportions.latest_samples(table(spark, folder, "manifest")))


P4_CATEGORIES = r"""
WITH last AS (
  SELECT sample_id, task, expected_label FROM manifest WHERE sample_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at DESC NULLS LAST) = 1),
spelled AS (
  SELECT nullif(trim(regexp_replace(lower(task), '[\s\p{Z}_-]+', ' ', 'g')), '') AS task,
    nullif(trim(regexp_replace(lower(expected_label), '[\s\p{Z}_-]+', ' ', 'g')), '') AS expected_label FROM last)
SELECT task, expected_label, count(*) AS available FROM spelled GROUP BY ALL
"""


def p6_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares wanted and reached per source."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    leaks = leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "heldout_items"))
    return leaks.filter("kind = 'verbatim'").select("doc_id", "item_id")


def p5_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Verbatim leaks and paraphrases with the share of common order."""
    leaks = leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "heldout_items"))
    return leaks.select("doc_id", "item_id", "kind", F.round("lcs_share", 4).alias("lcs_share"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal.find_mentions(table(spark, folder, "documents"), table(spark, folder, "apps")).select("doc_id", "pii_kind", "pii_text").distinct()


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with placeholders instead of personal information."""
    return personal.redact(table(spark, folder, "documents").select("doc_id", "lang", "text"), table(spark, folder, "apps"))


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_packed": p2_packed,
    "p2_fill": p2_fill,
    "p2_lengths": p2_lengths,
    "p4_sample": p4_sample,
    "p4_report": p4_report,
    "p4_categories": p4_categories,
    "p5_found": p5_found,
    "p5_leaks": p5_leaks,
    "p6_mix": p6_mix,
    "p6_shares": p6_shares,
    "p7_found": p7_found,
    "p7_redacted": p7_redacted,
}
SQL: dict[str, str] = {"p2_lengths": P2_LENGTHS, "p4_categories": P4_CATEGORIES}
