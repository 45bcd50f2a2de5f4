"""Line-oriented formats read with built-in functions only: one scan, no shuffle beyond a document's own lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blocks(text: Column) -> Column:
    """Blocks between blank lines."""
    return F.split(text, "\\n[ \\t]*\\n")


def properties(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line_no, name, value`` of key=value lines; comments and blank lines are skeleton."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    pattern = "^([A-Za-z0-9_.\\-]+)=(.*)$"
    return rows.where(F.col("line").rlike(pattern)).select(key, "line_no", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("value"))


def cues(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Subtitle cues: number, begin and end in milliseconds, text."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(_blocks(F.col(text))).alias("pos", "block"))
    pattern = "^\\s*([0-9]+)\\n([0-9]{2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{3}) --> ([0-9]{2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{3})\\n((?s:.*))$"
    part = lambda i: F.regexp_extract("block", pattern, i)
    ms = lambda i: part(i).cast("bigint") * 3600000 + part(i + 1).cast("bigint") * 60000 + part(i + 2).cast("bigint") * 1000 + part(i + 3).cast("bigint")
    return rows.where(F.col("block").rlike(pattern)).select(key, part(1).cast("bigint").alias("cue"), ms(2).alias("begin_ms"), ms(6).alias("end_ms"), part(10).alias("cue_text"))


def po_entries(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Entries of a message catalogue: id, text, whether it is approved (not fuzzy and not blank)."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(_blocks(F.col(text))).alias("entry", "block"))
    found = rows.where(F.col("block").rlike("(?m)^msgid \"") & F.col("block").rlike("(?m)^msgstr \""))
    msgid, msgstr = F.regexp_extract("block", '(?m)^msgid "(.*)"$', 1), F.regexp_extract("block", '(?m)^msgstr "(.*)"$', 1)
    return found.select(key, "entry", msgid.alias("msgid"), msgstr.alias("msgstr"), ((F.trim(msgstr) != "") & ~F.col("block").rlike("(?m)^#,.*fuzzy")).alias("approved"))


def paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs between blank lines; blank ones are skeleton."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(_blocks(F.col(text))).alias("para", "paragraph"))
    return rows.where(F.trim("paragraph") != "")


def json_leaves(df: DataFrame, key: str, text: str) -> DataFrame:
    """Members of a flat JSON object; values that are no strings are kept by their notation."""
    return df.select(F.col(key), F.explode(F.from_json(text, "map<string,string>")).alias("name", "value"))


def detect_format(text: Column) -> Column:
    """Format by the first 40,960 characters; the first rule that fits decides."""
    head = F.substring(text, 1, 40960)
    return (
        F.when(F.coalesce(F.trim(head), F.lit("")) == "", "empty")
        .when(head.rlike("^\\s*<\\?xml[^>]*>\\s*<xliff") | head.rlike("^\\s*<xliff"), "xliff")
        .when(head.rlike("^\\s*(<!DOCTYPE html|<html|<HTML)"), "html")
        .when(head.rlike("^\\s*<\\?xml") | head.rlike("^\\s*<[A-Za-z]"), "xml")
        .when(head.rlike("^WEBVTT"), "vtt")
        .when(head.rlike("^\\s*[0-9]+\\n[0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3} --> "), "srt")
        .when(head.rlike("^\\s*[{\\[]\\s*[\"{\\[]"), "json")
        .when(head.rlike("^(#.*\\n|\\s)*(msgctxt|msgid) \""), "po")
        .when(head.rlike("^(#.*\\n|\\s)*[A-Za-z0-9_.\\-]+\\s?=\\s?\\S"), "properties")
        .when(head.rlike("^<\\?php|^\\s*return \\[|array\\("), "php")
        .when(head.rlike("^(#{1,6} |---\\n)"), "markdown")
        .otherwise("text")
    )
