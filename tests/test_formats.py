"""Readers and writers of text formats: goldens, and that nothing is lost where nothing is translated."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segforge.sources import formats
from segforge.sources.formats import FORMATS, slots, write

BITS = ["a", " ", "\n", "\n\n", "<p>", "</p>", "<b>", '"', "'", "\\", "=", ":", "#", "&amp;", "|", "- ", "msgid ", "msgstr ", '""\n', "1\n", "00:00:01,000 --> 00:00:02,000\n", "{", "}", "=>", ",", "é日", "<source>", "</source>", "<target>", "</target>", "<segment>", "</segment>", "<!--", "-->", "<String `", "'>", "```", "/*", "*/", "//"]


@pytest.mark.parametrize("fmt", sorted(FORMATS))
@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=25).map("".join))
def test_nothing_is_lost(fmt, text):
    assert write(fmt, text, []) == text
    assert write(fmt, text, [None] * len(slots(fmt, text))) == text


@pytest.mark.parametrize(
    "fmt, text, want",
    [
        ("plaintext", "A one. B two.\n\nC", ["A one. B two.", "C"]),
        ("properties", "# c\nk1=Hello\\nWorld\nk2=caf\\u00e9\nk3 : a \\\n   b\n! x=y\n", ["Hello\nWorld", "café", "a b"]),
        ("po", '#, fuzzy\nmsgid "a"\nmsgstr "b"\n', ["a"]),
        ("po", 'msgid ""\nmsgstr "Plural-Forms: nplurals=2;"\n\nmsgid "%d file"\nmsgid_plural "%d files"\nmsgstr[0] ""\nmsgstr[1] ""\n', ["%d file", "%d files"]),
        ("po", 'msgid ""\n"one "\n"two"\nmsgstr ""\n', ["one two"]),
        ("srt", "1\n00:00:01,000 --> 00:00:02,000\n<i>Hi</i>\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nBye", ["<i>Hi</i>\nthere", "Bye"]),
        ("vtt", "WEBVTT\n\nid\n00:01.000 --> 00:02.000\n<v Ann>Hi\n", ["<v Ann>Hi"]),
        ("json", '{"a":"x","b":["y",{"c":"z"}],"n":1,"e":""}', ["x", "y", "z"]),
        ("html", "<p>Hi <b>you</b> &amp;\n me</p><script>x</script><p> </p>", ["Hi <b>you</b> & me"]),
        ("markdown", "# T #\n\n- a\n- b\n\n|x|y|\n|--|--|\n\nlong\nline\n\n```\ncode\n```\n", ["T", "a", "b", "x", "y", "long line"]),
        ("php", "<?php return ['a' => 'it\\'s', \"b\" => \"x\\ny\"];", ["it's", "x\ny"]),
        ("javascript", "// a: 'no'\nvar x = {a: 'b', \"c\": \"d\\u0041\"};", ["b", "dA"]),
        ("rc", '#include "x.h"\n IDS_A "say ""hi""\\n"\n', ['say "hi"\n']),
        ("mif", "<String `it\\q s \\x40 \\>'>", ["it' s @>"]),
        ("resx", '<data name="a" xml:space="preserve"><value>A &lt; B</value></data><data name="b" type="x"><value>no</value></data>', ["A < B"]),
        ("ts", "<message><source>a</source><translation>b</translation></message>", ["a"]),
        ("xliff1", '<trans-unit id="1" approved="yes"><source>a</source><alt-trans><source>x</source><target>y</target></alt-trans><target>b</target></trans-unit>', ["a"]),
        ("xml", "<a><!-- no --><b x='>'>one</b> <![CDATA[raw]]></a>", ["one"]),
        ("icml", "<Content>a</Content><Content> </Content>", ["a"]),
    ],
)
def test_read(fmt, text, want):
    assert [s.unit for s in slots(fmt, text)] == want


def test_write_translations():
    assert write("properties", "a=b\nc=d", ["x\\y\n", None]) == "a=x\\\\y\\n\nc=d"
    assert write("po", 'msgid "a"\nmsgstr ""\n', ['"q"']) == 'msgid "a"\nmsgstr "\\"q\\""\n'
    assert write("html", "<p>a <b>b</b></p>", ["c <i>d</i> < e & f"]) == "<p>c <i>d</i> &lt; e &amp; f</p>"
    assert write("html", None, []) is None and formats.pieces("html", "") == []
    assert write("ts", "<message><source>a</source><translation></translation></message>", ["b & c"]) == "<message><source>a</source><translation>b &amp; c</translation></message>"


def test_notes_names_and_approval():
    s = slots("properties", "# one\n# two\nk=v\n")[0]
    assert (s.name, s.note) == ("k", "one\ntwo")
    s = slots("po", '# n\n#, fuzzy\nmsgctxt "c"\nmsgid "a"\nmsgstr "b"\n')[0]
    assert (s.source, s.text, s.approved, s.name, s.note) == ("a", "b", False, "c", "n")
    assert slots("vtt", "WEBVTT\n\n00:01.000 --> 00:02.000\n<v Ann>Hi")[0].note == "00:01.000 --> 00:02.000\nAnn"
    assert [s.approved for s in slots("ts", '<message><source>a</source><translation type="unfinished">b</translation></message><message><source>c</source><translation>d</translation></message>')] == [False, True]
    assert formats.plural_forms('"Plural-Forms: nplurals=3; plural=n;"') == 3 and formats.plural_forms("") == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, "a=b\nc=d", ["x"]), (2, None, None), (3, "", [])], "k bigint, t string, new array<string>")
    assert [tuple(r) for r in formats.write_documents(df, "properties", "k", "t", "new").orderBy("k").collect()] == [(1, "a=x\nc=d"), (2, None), (3, "")]
    assert [r["source"] for r in formats.read_units(df, "properties", "k", "t").orderBy("ord").collect()] == ["b", "d"]
