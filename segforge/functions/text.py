"""Scalar text functions as Column builders; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that part words, and characters that part a word without digits again.
WORD_BREAKS = " \\t\\r\\n()?\\u00A0\\u3001\\u3002\\uFF1A\\uFF01\\uFF1F\\u4ECB"
INNER_BREAKS = ".,\\-/<>"
JAVA_SPACES = "[\\t-\\r\\x1C-\\x1F \\x{1680}\\x{2000}-\\x{2006}\\x{2008}-\\x{200A}\\x{2028}\\x{2029}\\x{205F}\\x{3000}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Words of European text; a token without digits counts its parts. Null counts 0."""
    tokens = F.filter(F.split(F.coalesce(_col(text), F.lit("")), f"[{WORD_BREAKS}]+"), lambda t: t != "")
    parts = lambda t: F.size(F.filter(F.split(t, f"[{INNER_BREAKS}]+"), lambda p: p != ""))
    one = lambda t: F.when(~t.rlike(f"[{INNER_BREAKS}]") | t.rlike("\\p{Nd}"), F.lit(1)).otherwise(parts(t))
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda a, t: a + one(t))


def wide_characters(text: Column | str) -> Column:
    """Characters beyond Latin-1 that count as a word each in Chinese, Japanese and Korean text."""
    return F.length(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "[\\x{00}-\\x{FF}\\x{3001}\\x{3002}\\x{FF1A}\\x{FF01}\\x{FF1F}\\x{4ECB}]", "")).cast("bigint")


def words_cjk(text: Column | str) -> Column:
    narrow = F.regexp_replace(F.coalesce(_col(text), F.lit("")), "[^\\x{00}-\\x{FF}\\x{3001}\\x{3002}\\x{FF1A}\\x{FF01}\\x{FF1F}\\x{4ECB}]", "")
    return wide_characters(text) + words(narrow)


def spaces(text: Column | str) -> Column:
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(JAVA_SPACES)).cast("bigint")


def normalise(text: Column | str) -> Column:
    """Line ends to spaces, runs of Unicode separators to one space, controls and spaces trimmed."""
    flat = F.regexp_replace(F.regexp_replace(_col(text), "\\n", " "), "\\p{Z}+", " ")
    return F.regexp_replace(F.regexp_replace(flat, "^[\\x00-\\x20]+", ""), "[\\x00-\\x20]+$", "")


def pseudo(text: Column | str) -> Column:
    return F.translate(_col(text), "aeiouAEIOU", "áèîöúÁÈÎÖÚ")


def has_text(text: Column | str) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(_col(text), "<[^>]*>", "")) != "", F.lit(False))


def escape_xml(text: Column | str) -> Column:
    return F.replace(F.replace(F.replace(_col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def quality(text: Column | str) -> Column:
    """Whole-number match quality; anything else is none."""
    return F.when(_col(text).rlike("^[+-]?[0-9]{1,9}$"), _col(text).try_cast("int"))


def band(q: Column) -> Column:
    """Match band of a quality; over 100 and under 50 are new."""
    return (
        F.when(q == 100, "exact").when((q >= 95) & (q < 100), "95").when((q >= 85) & (q < 95), "85")
        .when((q >= 75) & (q < 85), "75").when((q >= 50) & (q < 75), "50").otherwise("new")
    )


def primary_tag(tag: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(tag), "^[A-Za-z]+", 0))


def clean_tag(tag: Column | str) -> Column:
    """Language tag as it should be written: language in small letters, script titled, region in capitals."""
    parts = F.split(F.replace(_col(tag), F.lit("_"), F.lit("-")), "-")
    rest = F.transform(F.slice(parts, 2, 8), lambda p: F.when(F.length(p) == 2, F.upper(p)).when(F.length(p) == 4, F.initcap(p)).otherwise(F.lower(p)))
    return F.array_join(F.concat(F.array(F.lower(parts[0])), rest), "-")


def sentence_lite(text: Column | str) -> Column:
    """Segments by the default break rule only: a terminator run, white space, then anything else."""
    return F.split(F.regexp_replace(_col(text), "([.?!]+)(\\s+)(\\S)", "$1\u2029$2$3"), "\u2029")
