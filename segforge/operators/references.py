"""What refers to what: members reached from roots, and content taken over by reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.io import materialise
from segforge.operators import keys


def discover(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """``node, depth`` of everything that ``roots`` (``node``) reach over ``edges`` (``node, ref``), with the fewest steps; at most
    ``depth`` steps where that is given. Each round joins only what is new, so rings end; null references lead nowhere."""
    links = edges.select("node", "ref").where("node is not null and ref is not null").distinct()
    seen = frontier = materialise(roots.select("node", F.lit(0).alias("depth")).distinct())
    step = 0
    while depth is None or step < depth:
        step += 1
        ahead = links.join(frontier.select("node"), "node").select(F.col("ref").alias("node")).distinct()
        frontier = materialise(ahead.join(seen.select("node"), "node", "left_anti").select("node", F.lit(step).alias("depth")))
        if not frontier.head(1):
            break
        seen = materialise(seen.unionByName(frontier))
    return seen


def take_over(elements: DataFrame) -> DataFrame:
    """``id, content`` of ``id, ref, content``: an element with a reference has the content of what its chain of references ends at. A
    chain that is a ring, or ends at nothing that there is, leaves the element's own content."""
    ends = keys.resolve(elements.where("ref is not null").select(F.col("id").alias("k"), "ref")).select(F.col("k").alias("id"), "ends_at")
    there = elements.where("ref is null").select(F.col("id").alias("ends_at"), F.col("content").alias("taken"), F.lit(True).alias("found"))
    joined = elements.select("id", "content").join(ends, "id", "left").join(there, "ends_at", "left")
    return joined.select("id", F.when(F.col("found"), F.col("taken")).otherwise(F.col("content")).alias("content"))


def scoped(defined: DataFrame, used: DataFrame, scopes: DataFrame) -> DataFrame:
    """``id, scope, key, value`` of uses of keys (``id, scope, key``): the definition (``scope, key, value``) in the scope itself or in the
    nearest one around it (``scopes``: ``scope, parent``), null if none has it. Rounds stop when no open use has a scope above it."""
    first = defined.groupBy("scope", "key").agg(F.min("value").alias("value"))
    above = scopes.select(F.col("scope").alias("at"), F.col("parent"))
    open_ = used.select("id", "scope", "key", F.col("scope").alias("at"))
    done = None
    while True:
        tried = materialise(open_.join(first.select(F.col("scope").alias("at"), "key", "value"), ["at", "key"], "left").join(above, "at", "left"))
        ended = tried.where("value is not null or parent is null").select("id", "scope", "key", "value")
        done = ended if done is None else done.unionByName(ended)
        open_ = tried.where("value is null and parent is not null").select("id", "scope", "key", F.col("parent").alias("at"))
        if not open_.head(1):
            return done
