"""Reference chains, packages and the rule engine on small cases."""

import io
import zipfile

import pytest

from segforge import segmenter
from segforge.operators import keys, references
from segforge.plans import packages as made
from segforge.segmenter import Rule
from segforge.sources import packages


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_chains_of_any_length_and_rings(spark):
    long = [(f"k{i}", f"k{i + 1}") for i in range(37)]
    df = spark.createDataFrame([*long, ("a", "b"), ("b", "a"), ("x", "a"), ("y", "y"), (None, "z"), ("n", None)], "k string, ref string")
    got = {r[0]: r[1:] for r in rows(keys.resolve(df))}
    assert all(got[f"k{i}"] == ("k37", 37 - i) for i in range(37))
    assert got["a"] == got["b"] == got["x"] == got["y"] == (None, None) and None not in got and "n" not in got
    assert keys.resolve(df.limit(0)).count() == 0


def test_discovery(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("b", "c"), ("z", "q"), ("a", None)], "node string, ref string")
    roots = spark.createDataFrame([("r",)], "node string")
    assert rows(references.discover(edges, roots)) == {("r", 0), ("a", 1), ("b", 2), ("c", 3)}
    assert rows(references.discover(edges, roots, 1)) == {("r", 0), ("a", 1)}
    assert references.discover(edges, roots.limit(0)).count() == 0


def test_content_is_taken_over(spark):
    e = spark.createDataFrame([("a", "b", "A"), ("b", "c", "B"), ("c", None, "C"), ("d", "nowhere", "D"), ("e", "f", "E"), ("f", "e", "F"), ("g", "h", "G"), ("h", None, None)], "id string, ref string, content string")
    assert rows(references.take_over(e)) == {("a", "C"), ("b", "C"), ("c", "C"), ("d", "D"), ("e", "E"), ("f", "F"), ("g", None), ("h", None)}


def test_scopes(spark):
    s = lambda data, schema: spark.createDataFrame(data, schema)
    got = references.scoped(s([("in", "k", "1"), ("out", "k", "2"), ("out", "l", "3")], "scope string, key string, value string"), s([(1, "in", "k"), (2, "in", "l"), (3, "in", "m"), (4, "else", "k")], "id int, scope string, key string"), s([("in", "out")], "scope string, parent string"))
    assert {(r["id"], r["value"]) for r in got.collect()} == {(1, "1"), (2, "3"), (3, None), (4, None)}


@pytest.mark.parametrize("kind", sorted(made.SPELT))
def test_packages(kind):
    texts = [f"t {i} & <x>"[: 4 + i % 7] for i in range(12)]
    texts = [t.replace("<", "").strip() for t in texts]
    data = made.made(kind, texts)
    assert [s.unit for _, s in packages.slots(kind, data)] == texts
    same = packages.write(kind, data, [])
    read = lambda x: {n: zipfile.ZipFile(io.BytesIO(x)).read(n) for n in zipfile.ZipFile(io.BytesIO(x)).namelist()}
    assert read(same) == read(data)
    assert [s.text for _, s in packages.slots(kind, packages.write(kind, data, ["new & <b>"] + [None] * 11))][0] in ("new & <b>", "new & ")
    assert packages.slots(kind, None) == [] and packages.write(kind, None, []) is None
    with pytest.raises(zipfile.BadZipFile):
        packages.slots(kind, b"no archive")


def test_rules_see_any_length():
    rules = (Rule(".*", False, "[ ]a{3,}\\.", " "), Rule(".*", True, "\\.", " "))
    text = "x " + "a" * 500 + ". y. z"
    assert segmenter.segment(text, "en", rules) == ["x " + "a" * 500 + ". y.", " z"]


def test_what_precedes_begins_with_the_segment():
    rules = (Rule(".*", False, "One\\. Two\\.", " "), Rule(".*", True, "\\.", " "))
    assert segmenter.segment("One. Two. Three", "en", rules) == ["One.", " Two.", " Three"]


def test_tags_are_hidden():
    rules = (Rule(".*", True, "\\.", " "),)
    assert segmenter.segment_tagged('A<b>.</b> B.<ph id="1">. x</ph> C', "en", rules) == ["A<b>.", "</b> B.", '<ph id="1">. x</ph> C']
    assert segmenter.seg_source("A. B", "en", rules) == '<mrk mtype="seg" mid="0">A.</mrk><mrk mtype="seg" mid="1"> B</mrk>'
    assert segmenter.segment_tagged(None, "en") == [] and "".join(segmenter.segment_tagged("<a>x. y</a>", "en", rules)) == "<a>x. y</a>"


def test_resegment():
    rules = (Rule(".*", True, "\\.", " "),)
    assert segmenter.resegment("u", "A. B", None, "en", rules) == [("segment", "u-1", "A."), ("segment", "u-2", " B")]
    assert segmenter.resegment("u", "A. B", "C. D", "en", rules) == [("segment", "u", "A. B")]
    assert segmenter.resegment("u", "A. <x/>", "", "en", rules) == [("segment", "u", "A."), ("ignorable", "", " <x/>")]
