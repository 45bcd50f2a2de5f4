"""Inline tags and codecs on edges: null, empty, nothing to find, several in a row."""

from pyspark.sql import functions as F

from segforge.functions import codecs, inline


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(column).collect()]


def test_tags(spark):
    c = F.col("c")
    assert one(spark, inline.numbered(c), None, "", "a", "<b>x</b>", "<b><i>") == [None, "", "a", '<ph id="0">&lt;b&gt;</ph>x<ph id="1">&lt;/b&gt;</ph>', '<ph id="0">&lt;b&gt;</ph><ph id="1">&lt;i&gt;</ph>']
    assert one(spark, inline.merged(c), "<b><i>x") == ['<ph id="0">&lt;b&gt;&lt;i&gt;</ph>x']
    assert one(spark, F.concat_ws("|", *inline.edges(c)), "<b>x</b>", "<b>x", "x</b>", "<b>x<i>y</b>", "x", "<b>") == ["<b>|x|</b>", "<b>|x|", "|x|</b>", "|<b>x<i>y</b>|", "|x|", "<b>||"]
    assert one(spark, inline.pure(c), None, 'a<ph id="1">x</ph><mrk mtype="protected">b</mrk><x id="1"/>c') == [None, "abc"]
    assert one(spark, inline.numbered(c, inline.C_FORMAT), "100 %d of %1$s, 5 %") == ['100 <ph id="0">%d</ph> of <ph id="1">%1$s</ph>, 5 %']
    assert one(spark, inline.without_changes(c), "<ins>a</ins><del>b</del>c") == ["ac"]


def test_codecs(spark):
    c = F.col("c")
    assert one(spark, codecs.from_bytes_hex(codecs.bytes_hex(c)), None, "", "aé日😀") == [None, "", "aé日😀"]
    assert one(spark, codecs.bytes_hex(c), "é") == ["BCD6"]
    assert one(spark, codecs.from_entities(c), None, "", "&lt;&amp;lt;&#65;&#x42;&eacute;&nope;&#20320;&") == [None, "", "<&lt;ABé&nope;你&"]
    assert one(spark, codecs.canonical_path(c), None, "", "a/./b/../c", "/a//b/", "../x", "a/../..") == [None, "", "a/c", "/a/b", "../x", ".."]
    assert one(spark, codecs.relative_path(F.lit("a/b"), c), "a/b/c", "a/c", "x", "a") == ["c", "../c", "../../x", ".."]
    assert one(spark, codecs.plural_forms(c), None, "nplurals = 3;", "x") == [0, 3, 0]
    assert one(spark, codecs.lookup(c, codecs.CODE_PAGES), None, "1252", "1") == [None, "windows-1252", None]
    assert one(spark, codecs.is_name(c), None, "a-b", "1a", "") == [None, True, False, False]
