"""Mixing sources to target weights without sorting.

Documents get a hash; tokens are summed by source and hash bucket in one pass that serves all mixes. For each mix and
source the budget left after whole repeats is turned into a hash threshold: the running sum over buckets shows the
bucket in which the budget ends, only that bucket's documents are summed again by finer bits, and so on until a bucket
of the finest level is reached. A document is used once more exactly when its hash lies below the threshold. Because
all mixes share the hashes, a smaller budget's documents are always part of a larger one's.

Size of a mix: ``total_tokens`` if given, else the largest size that every source with a positive weight can fill
within its repeats. A source that can't fill its target gives all its repeats and the report says so.

Defined results: null and empty texts have 0 tokens and are never used; so are documents of no source or of a source without
weight. Repeated rows are documents of their own and follow their id's hash. A source without documents reaches 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segforge.io import materialise
from segforge.llm import tokens

#: Bits of each level's bucket. After the last level a bucket holds one document in 2**36.
LEVELS = (12, 12, 12)


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, h``; h is a hash of 36 bits."""
    docs = documents.select(F.col("doc_id").cast("bigint"), "source", "text").where("source is not null and text is not null and text <> ''")
    return tokens.count(docs, path=path).withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - sum(LEVELS)))


def budgets(sizes: DataFrame, weights: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """For each mix and source: tokens there are, target, whole repeats and tokens left for a part of the documents."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    w = weights.select("mix", "source", F.col("weight").cast("double"), F.col("max_repeats").cast("int"))
    joined = w.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    feasible = F.min(F.when((F.col("weight") > 0) & (F.col("available") > 0), F.col("available") * F.col("max_repeats") / F.col("weight"))).over(Window.partitionBy("mix"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(feasible, F.lit(0.0))
    joined = joined.withColumn("target_tokens", F.col("weight") * total)
    usable = F.least(F.col("target_tokens"), (F.col("available") * F.col("max_repeats")).cast("double"))
    whole = F.when(F.col("available") > 0, F.floor(usable / F.col("available"))).otherwise(0).cast("int")
    return joined.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), usable - F.col("whole") * F.col("available")))


def thresholds(sizes: DataFrame, budget: DataFrame) -> DataFrame:
    """Adds ``below``: documents with a smaller hash fit into ``rest``. One small aggregate a level; the table of open
    buckets has a row for each mix and source."""
    budget = materialise(budget)
    open_ = budget.select("mix", "source", F.col("rest"), F.lit(0).cast("bigint").alias("prefix"))
    taken = 0
    for bits in LEVELS:
        taken += bits
        down = sum(LEVELS) - taken
        level = sizes.withColumn("bucket", F.shiftright("h", down)).withColumn("prefix", F.shiftright("h", down + bits))
        if taken > bits:
            level = level.join(open_.select("source", "prefix").distinct(), ["source", "prefix"], "left_semi")
        sums = level.groupBy("source", "prefix", "bucket").agg(F.sum("n_tokens").alias("t"))
        order = Window.partitionBy("mix", "source").orderBy("bucket")
        running = open_.join(sums, ["source", "prefix"]).withColumn("upto", F.sum("t").over(order))
        fits = running.where("upto <= rest").groupBy("mix", "source").agg(F.max("upto").alias("used"), F.max("bucket").alias("last"))
        over = F.min(F.struct("bucket", "t")).alias("over")
        crossing = running.where("upto > rest").groupBy("mix", "source").agg(over).select("mix", "source", F.col("over.bucket").alias("crossing"), F.col("over.t").alias("t"))
        nothing_crosses = F.shiftleft(F.col("prefix") + 1, bits) if taken > bits else F.lit(1 << bits)
        open_ = (
            open_.join(fits, ["mix", "source"], "left").join(crossing, ["mix", "source"], "left")
            .select("mix", "source", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"), F.coalesce("crossing", nothing_crosses).cast("bigint").alias("prefix"), "t")
        )
        # the document at the border is used too where that comes nearer to the target
        nearer = F.col("prefix") + F.coalesce(F.col("t") < 2 * F.col("rest"), F.lit(False)).cast("int")
        level = materialise(open_.withColumn("below", nearer))  # a row for each mix and source
        below, open_ = level.select("mix", "source", "below"), level.drop("t", "below")
    return budget.join(below, ["mix", "source"])


def mix(documents: DataFrame, weights: DataFrame, total_tokens: int | None = None, path: str | None = None, sizes: DataFrame | None = None, planned: DataFrame | None = None) -> DataFrame:
    """``mix, doc_id, source, n_tokens, copies``: every document used, with how often."""
    sizes = sized(documents, path) if sizes is None else sizes
    planned = thresholds(sizes, budgets(sizes, weights, total_tokens)) if planned is None else planned
    plan = planned.select("mix", "source", "whole", "below")
    used = sizes.join(plan, "source").withColumn("copies", F.col("whole") + (F.col("h") < F.col("below")).cast("int"))
    return used.where("copies > 0 and n_tokens > 0").select("mix", "doc_id", "source", "n_tokens", "copies")


def shares(documents: DataFrame, weights: DataFrame, total_tokens: int | None = None, path: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """The report: for each mix and source the target and what was reached."""
    sizes = sized(documents, path) if sizes is None else sizes
    plan = materialise(thresholds(sizes, budgets(sizes, weights, total_tokens)))
    got = mix(documents, weights, total_tokens, path, sizes, plan).groupBy("mix", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    out = plan.join(got, ["mix", "source"], "left").na.fill(0, ["tokens", "documents", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy("mix"))
    return out.select("mix", "source", "weight", "max_repeats", "available", "target_tokens", "tokens", "documents", "most_copies", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("share"))
