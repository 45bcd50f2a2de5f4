"""Taking documents apart and putting them together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segforge.functions import text as T


def lines(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line_no, line``: the skeleton of a document as rows."""
    return documents.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def merge(skeleton: DataFrame, translations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document with its lines replaced by their approved translations, in order."""
    joined = skeleton.join(translations, [key, "line_no"], "left")
    pieces = F.sort_array(F.collect_list(F.struct("line_no", F.coalesce("translation", "line").alias("piece"))))
    return joined.groupBy(key).agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "\n").alias("text"), F.count("translation").alias("n_translated"))


def path_root(df: DataFrame, path: str, by: str) -> DataFrame:
    """Common root of the paths of each group: tokens are names and separators, kept up to the first place where paths
    differ, less the last one kept. Places are aggregated on their own, so no group is collected."""
    tokens = df.select(by, path).distinct().select(by, F.posexplode(F.regexp_extract_all(path, F.lit("([/\\\\:]|[^/\\\\:]+)"), 1)).alias("at", "token"))
    places = tokens.groupBy(by, "at").agg(F.min("token").alias("lo"), F.max("token").alias("hi"))
    ends = places.groupBy(by).agg(F.min(F.when(F.col("lo") != F.col("hi"), F.col("at"))).alias("differs"), F.max("at").alias("last"))
    kept = places.join(ends, by).where(F.col("at") < F.coalesce("differs", F.col("last") + 1) - 1)
    root = kept.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "lo"))), lambda p: p["lo"]), "").alias("root"))
    return ends.select(by).join(root, by, "left").select(by, F.coalesce("root", F.lit("")).alias("root"))


def compare(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Positional comparison: how each place of two documents differs."""
    joined = a.withColumn("_a", F.lit(True)).alias("a").join(b.withColumn("_b", F.lit(True)).alias("b"), on, "full_outer")
    kind = (
        F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").when(~F.col("a.source").eqNullSafe(F.col("b.source")), "source")
        .when(~F.col("a.target").eqNullSafe(F.col("b.target")), "target").otherwise("same")
    )
    return joined.withColumn("difference", kind)


def regroup(segments: DataFrame, by: list[str], order: str) -> DataFrame:
    """2.x segments back to one 1.2 unit: texts in order; approved if any segment is final. Without target a segment gives its source."""
    pieces = F.sort_array(F.collect_list(F.struct(order, "source", F.coalesce("target", "source").alias("t"))))
    return segments.groupBy(*by).agg(
        F.array_join(F.transform(pieces, lambda p: p["source"]), "").alias("source"), F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("target"),
        F.bool_or(F.coalesce(F.col("state") == "final", F.lit(False))).alias("approved"), F.count("*").alias("n_segments"),
    )


def tmx_unit(source: Column, target: Column, source_lang: Column, target_lang: Column, tuid: Column) -> Column:
    """One translation unit of a memory."""
    one = lambda lang, text: F.concat(F.lit('<tuv xml:lang="'), lang, F.lit('"><seg>'), T.escape_xml(F.trim(text)), F.lit("</seg></tuv>"))
    return F.concat(F.lit('<tu tuid="'), tuid, F.lit('">'), one(source_lang, source), one(target_lang, target), F.lit("</tu>"))


def target_name(original: Column, lang: Column) -> Column:
    """Name of the target file: the language before the last extension."""
    return F.when(original.rlike("\\.[^./]+$"), F.concat(F.regexp_replace(original, "\\.[^./]+$", ""), F.lit("_"), lang, F.regexp_extract(original, "(\\.[^./]+)$", 1))).otherwise(F.concat(original, F.lit("_"), lang))
