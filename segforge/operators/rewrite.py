"""Bulk updates of segments as column rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.functions import text as T

_EMPTY = "(target is null or trim(target) = '')"
_LOCKED = "(coalesce(lower(approved), 'no') = 'yes' or coalesce(state, '') = 'final' or coalesce(lower(translate), 'yes') = 'no')"


def pseudo_translate(df: DataFrame) -> DataFrame:
    change = F.expr(f"{_EMPTY} and not {_LOCKED} and source is not null")
    return df.withColumn("state", F.when(change, "translated").otherwise(F.col("state"))).withColumn("target", F.when(change, T.pseudo("source")).otherwise(F.col("target")))


def copy_sources(df: DataFrame) -> DataFrame:
    return df.withColumn("target", F.when(F.expr(_EMPTY), F.col("source")).otherwise(F.col("target")))


def approve_all(df: DataFrame) -> DataFrame:
    change = ~F.expr(_EMPTY)
    return df.withColumn("approved", F.when(change, "yes").otherwise(F.col("approved"))).withColumn("state", F.when(change, "final").otherwise(F.col("state")))


def remove_targets(df: DataFrame) -> DataFrame:
    """The state becomes initial only where there was one."""
    return df.withColumn("state", F.when(F.col("state").isNotNull(), "initial")).withColumn("target", F.lit(None).cast("string")).withColumn("approved", F.lit(None).cast("string"))


def state_2x(df: DataFrame) -> DataFrame:
    """State of a 2.x segment from 1.2 attributes."""
    new = F.when(F.expr("coalesce(lower(approved), 'no') = 'yes'") & T.has_text("target"), "final").when(T.has_text("target"), "translated").otherwise("initial")
    locked = F.when(F.expr("coalesce(lower(translate), 'yes') = 'no'"), "locked")
    return df.withColumn("state_2x", new).withColumn("sub_state", locked)


def apply_leverage(df: DataFrame, found: DataFrame) -> DataFrame:
    got = df.join(found.withColumnRenamed("target", "leveraged"), "unit_key", "left")
    hit = F.col("leveraged").isNotNull()
    return (
        got.withColumn("target", F.coalesce("leveraged", "target")).withColumn("state", F.when(hit, "signed-off").otherwise(F.col("state")))
        .withColumn("approved", F.when(hit, "yes").otherwise(F.col("approved"))).withColumn("state_qualifier", F.when(hit, "leveraged-inherited")).drop("leveraged")
    )
