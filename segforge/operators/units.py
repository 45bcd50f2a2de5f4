"""The segment model over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segforge.functions import text as T
from segforge.io import table


def units(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Every unit once, with the given columns or all. Re-sent rows differ in ``loaded_at`` only, so distinct rows are distinct
    units; a hash aggregate without sorting, over the columns that are needed."""
    every = table(spark, d, "trans_units").drop("loaded_at")
    return (every.select("unit_key", *columns) if columns else every).distinct()


def matches(spark: SparkSession, d: str) -> DataFrame:
    """Every offered match once, with its whole-number quality; repeats are exact."""
    return table(spark, d, "alt_trans").distinct().withColumn("quality", T.quality("match_quality"))


def best_quality(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d).groupBy("unit_key").agg(F.max("quality").alias("quality"))


def typed(spark: SparkSession, d: str) -> DataFrame:
    """Units with text, their counts, flags and type: ice, a match band or new."""
    u = units(spark, d, "file_id", "original", "seg_ord", "source", "target", "approved", "state", "translate").where("source is not null and trim(source) <> ''").join(best_quality(spark, d), "unit_key", "left")
    approved, translated = F.coalesce(F.lower("approved") == "yes", F.lit(False)), T.has_text("target")
    translatable = F.coalesce(F.lower("translate"), F.lit("yes")) != "no"
    n = T.words("source")
    kind = F.when(approved & (F.col("state") == "signed-off"), "ice").otherwise(T.band(F.coalesce("quality", F.lit(0))))
    return u.select(
        "unit_key", "file_id", "original", "seg_ord", "source", "target", approved.alias("approved"), translated.alias("translated"), translatable.alias("translatable"),
        F.when(translatable, n).otherwise(F.lit(0)).cast("bigint").alias("words"), F.when(translatable, F.lit(0)).otherwise(n).cast("bigint").alias("untranslatable"),
        (F.length("source").cast("bigint") - T.spaces("source")).alias("chars"), kind.alias("type"),
    )
