"""References resolved through tables of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.io import materialise


def resolve(edges: DataFrame) -> DataFrame:
    """``k, ends_at, steps`` of ``k, ref`` (one reference a key): where the chain of references ends and after how many steps.

    Pointers are doubled, so a chain of n steps takes about log2(n) rounds, however long it is; rounds stop when nothing moves.
    Keys of a ring and those that lead into one end nowhere: ``ends_at`` and ``steps`` are null. Null keys and references are ignored.
    """
    at = edges.where("k is not null and ref is not null").select("k", F.col("ref").alias("ends_at"), F.lit(1).cast("bigint").alias("steps"))
    total, rounds = at.count(), 0
    while True:
        ahead = at.select(F.col("k").alias("ends_at"), F.col("ends_at").alias("next"), F.col("steps").alias("more"))
        moved = at.join(ahead, "ends_at", "left")
        at = materialise(moved.select("k", F.coalesce("next", "ends_at").alias("ends_at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")))
        rounds += 1
        if not at.where("moved").head(1):
            return at.select("k", "ends_at", "steps")
        if 1 << (rounds - 1) > total:  # what still moves has gone farther than any chain without a ring
            return at.select("k", F.when(~F.col("moved"), F.col("ends_at")).alias("ends_at"), F.when(~F.col("moved"), F.col("steps")).alias("steps"))
        at = at.select("k", "ends_at", "steps")
