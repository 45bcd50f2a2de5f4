"""Validation as a table of violations: ``rule_id, element, key, detail``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.functions import text as T

# Rules by id.
RULES = {
    "dup-unit": "unit id is not unique in its file", "dup-alt": "match id is not unique", "ref-file": "unit refers to a file that doesn't exist", "ref-unit": "match refers to a unit that doesn't exist",
    "ref-product": "file refers to a product that doesn't exist", "lang-source": "source language is no known tag", "lang-target": "target language is no known tag", "empty-source": "translatable unit without source",
    "approved-empty": "approved unit without target", "quality": "match quality is no whole number from 0 to 100", "order": "place in the file is missing",
}
# States that a 1.2 target may have.
STATES = ["final", "needs-adaptation", "needs-l10n", "needs-review-adaptation", "needs-review-l10n", "needs-review-translation", "needs-translation", "new", "signed-off", "translated"]


def row(rule: str, df: DataFrame, key, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def duplicates(rule: str, df: DataFrame, by: list[str]) -> DataFrame:
    return row(rule, df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), F.concat_ws(":", *by), F.col("n"))


def dangling(rule: str, df: DataFrame, key: str, ref: str, others: DataFrame, other: str) -> DataFrame:
    known = others.select(F.col(other).alias(ref)).distinct()
    return row(rule, df.where(F.col(ref).isNotNull()).join(known, ref, "left_anti"), F.col(key), F.col(ref))


def unknown_language(rule: str, files: DataFrame, languages: DataFrame, column: str) -> DataFrame:
    known = languages.select(F.col("tag"))
    bad = files.where(F.col(column).isNotNull()).withColumn("tag", F.col(column)).join(known, "tag", "left_anti")
    return row(rule, bad, F.col("file_id"), F.col(column))


def violations(units: DataFrame, files: DataFrame, alternatives: DataFrame, products: DataFrame, languages: DataFrame) -> DataFrame:
    parts = [
        duplicates("dup-unit", units, ["file_id", "unit_id"]),
        duplicates("dup-alt", alternatives, ["alt_id"]),
        dangling("ref-file", units, "unit_key", "file_id", files, "file_id"),
        dangling("ref-unit", alternatives, "alt_id", "unit_key", units, "unit_key"),
        dangling("ref-product", files, "file_id", "product", products, "product"),
        unknown_language("lang-source", files, languages, "source_language"),
        unknown_language("lang-target", files, languages, "target_language"),
        row("empty-source", units.where("coalesce(lower(translate), 'yes') <> 'no' and (source is null or trim(source) = '')"), F.col("unit_key"), F.lit("")),
        row("approved-empty", units.where("approved = 'yes' and (target is null or trim(target) = '')"), F.col("unit_key"), F.lit("")),
        row("quality", alternatives.where(F.coalesce(~T.quality("match_quality").between(0, 100), F.col("match_quality").isNotNull())), F.col("alt_id"), F.col("match_quality")),
        row("order", units.where("seg_ord is null"), F.col("unit_key"), F.lit("")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pair_balance(text):
    """Opening less closing tags."""
    return F.regexp_count(text, F.lit("<[A-Za-z][^>/]*>")) - F.regexp_count(text, F.lit("</[A-Za-z][^>]*>"))


def date_valid(text):
    """A date and time of the fixed form YYYY-MM-DDThh:mm:ssZ that exists."""
    return F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull(), F.lit(False))
