"""In-context exact matches between deliveries of one original.

Neighbours come from one window over each file. Equal texts and contexts are reduced before they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_context(units: DataFrame) -> DataFrame:
    """Units with the sources before and after; null at the ends of the file. One shuffle by file; a file is one document."""
    place = Window.partitionBy("file_id").orderBy("seg_ord")
    text = F.coalesce("source", F.lit(""))
    return units.withColumn("before", F.lag(text).over(place)).withColumn("after", F.lead(text).over(place))


def leverage(new: DataFrame, old: DataFrame) -> DataFrame:
    """``unit_key, target``: for each new unit that isn't approved the target of the last approved old unit of the same original
    with equal text and neighbours. A unit at an end of its file has no condition on that side; a hot text is grouped
    before the join: old units are reduced to the last one for each original, text and context."""
    last = _offered(old).groupBy("original", "source", "before", "after").agg(F.max(F.struct("file_id", "seg_ord", "target")).alias("last"))
    return _best(_wanted(new), last, "true")


def from_earlier(units: DataFrame, approved_too: bool = False) -> DataFrame:
    """As ``leverage`` of every delivery from all earlier ones of its original. ``delivery``: number in order of arrival.
    ``approved_too``: units that are approved already are leveraged as well."""
    old = _offered(units).groupBy("original", "source", "before", "after", "delivery").agg(F.max(F.struct("delivery", "seg_ord", "target")).alias("last"))
    return _best(_wanted(units.withColumn("approved", F.lit(None).cast("string")) if approved_too else units), old, "o.delivery < n.delivery")


def _wanted(units: DataFrame) -> DataFrame:
    return units.where("coalesce(lower(approved), 'no') <> 'yes' and coalesce(lower(translate), 'yes') <> 'no' and source is not null and trim(source) <> ''")


def _offered(units: DataFrame) -> DataFrame:
    return units.where("approved = 'yes' and target is not null and trim(target) <> '' and source is not null")


def _best(n: DataFrame, last: DataFrame, where: str) -> DataFrame:
    joined = n.alias("n").join(last.alias("o"), F.expr(f"n.original = o.original and n.source = o.source and (n.before is null or n.before = o.before) and (n.after is null or n.after = o.after) and {where}"))
    return joined.groupBy("n.unit_key").agg(F.max("o.last").alias("best")).select("unit_key", F.col("best.target").alias("target"))


def deliveries(files: DataFrame) -> DataFrame:
    """Files with ``delivery``: their number among those of their original in order of arrival."""
    return files.withColumn("delivery", F.row_number().over(Window.partitionBy("original").orderBy("received_at", "file_id")))
