"""Statistics over typed segments.

Repetitions need no window: the first occurrence of a text is one aggregate with partial sums, and every row compares
itself with it through a salted join, so a text that a third of all rows share is no hot partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.io import skew_join

ORDER = ["file_order", "original", "file_id", "seg_ord", "unit_key"]


def repetitions(typed: DataFrame) -> DataFrame:
    """Type of each segment: the first new occurrence stays new, later ones are rep-int in its file and rep-ext elsewhere.
    Files are ordered without regard to case; deliveries of one original are one file. Equal texts with other counts or flags are no repetitions."""
    rows = typed.withColumn("file_order", F.lower("original"))
    key = F.xxhash64("source", "words", "untranslatable", "chars", "approved", "translated", "type")
    new = rows.where("type = 'new'").withColumn("k", key)
    firsts = new.groupBy("k", "source", "approved", "translated").agg(F.min(F.struct(*ORDER)).alias("first"))
    joined = skew_join(new, firsts, ["k", "source", "approved", "translated"], F.col("unit_key"))
    kind = F.when(F.col("first.unit_key") == F.col("unit_key"), "new").when(F.col("first.original") == F.col("original"), "rep-int").otherwise("rep-ext")
    return joined.withColumn("type", kind).select(*typed.columns).unionByName(rows.where("type <> 'new'").select(*typed.columns))


def _sum(condition, value="1"):
    return F.sum(F.when(F.expr(condition), F.expr(value)).otherwise(0)).cast("bigint")


def by_file(df: DataFrame, *measures) -> DataFrame:
    """Measures of each file and, with a null original, of all."""
    return df.rollup("original").agg(*measures)


def segment_types(classified: DataFrame) -> DataFrame:
    names = {"new": "new", "ice": "ice", "rep_int": "rep-int", "rep_ext": "rep-ext"}
    return by_file(classified, *[_sum(f"type = '{v}'").alias(k) for k, v in names.items()], _sum("type not in ('new', 'ice', 'rep-int', 'rep-ext')").alias("matches"), F.count("*").alias("segments"))


def word_bands(classified: DataFrame) -> DataFrame:
    names = {"w_new": "type = 'new'", "w_ice": "type = 'ice'", "w_exact": "type = 'exact'", "w_95": "type = '95'", "w_85": "type = '85'", "w_75": "type = '75'", "w_50": "type = '50'", "w_repeated": "type like 'rep%'"}
    return by_file(classified, *[_sum(v, "words").alias(k) for k, v in names.items()], F.sum("untranslatable").cast("bigint").alias("untranslatable"), F.sum("words").cast("bigint").alias("words"))


def status(typed: DataFrame, value: str) -> DataFrame:
    """Approved and translated by ``value``: 1 for segments, words or chars."""
    return by_file(typed, *[_sum(c, value).alias(n) for n, c in (("approved", "approved"), ("not_approved", "not approved"), ("translated", "translated"), ("not_translated", "not translated"))])


def word_vector(typed: DataFrame) -> DataFrame:
    """The eleven sums of translatable words; repetitions count within their file only."""
    t = typed.where("translatable")
    key = F.xxhash64("source")
    firsts = t.where("type = 'new'").groupBy("original", key.alias("k"), "source").agg(F.min(F.struct("file_id", "seg_ord", "unit_key")).alias("first"))
    new = skew_join(t.where("type = 'new'").withColumn("k", key), firsts, ["original", "k", "source"], F.col("unit_key"))
    new = new.withColumn("type", F.when(F.col("first.unit_key") == F.col("unit_key"), "new").otherwise("rep-int")).select(*t.columns)
    rows = new.unionByName(t.where("type <> 'new'"))
    names = {"new": "type = 'new'", "exact": "type = 'exact'", "repeated": "type = 'rep-int'", "b95": "type = '95'", "b85": "type = '85'", "b75": "type = '75'", "b50": "type = '50'", "all_words": "true", "approved": "approved", "translated": "translated", "ice": "type = 'ice'"}
    return rows.agg(*[F.coalesce(_sum(c, "words"), F.lit(0)).cast("bigint").alias(n) for n, c in names.items()])


def bars(typed: DataFrame, size: int) -> DataFrame:
    """Segments of a file in buckets of ``size``: majority vote on approval and share of translated ones."""
    b = typed.groupBy("file_id", F.floor(F.col("seg_ord") / size).cast("bigint").alias("bucket"))
    out = b.agg(F.count("*").alias("n"), _sum("approved").alias("n_approved"), F.round(F.avg(F.col("translated").cast("double")), 6).alias("translated_share"))
    return out.withColumn("approved", F.col("n_approved") > F.floor(F.col("n") / 2))
