"""Documents of every text format, made from the project's units, read, and written with their translations.

A format's template says how a document is spelt. From the one template come the document in Spark, which goes through reader and
writer, and, in SQL, the document that the writer must give.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segforge.operators.units import units
from segforge.sources import formats

#: What a template holds besides plain strings: the unit's key, its source, and the place of its translation.
ID, SOURCE, SLOT = "\0id", "\0source", "\0slot"
_AMP = [("&", "&amp;")]
_SLASH, _QUOTE = ("\\", "\\\\"), ('"', '\\"')
# Fixed values: (before, each unit, between, after, escapes, whether the slot stands beside its source).
TEMPLATES: dict[str, tuple[str, list[str], str, str, list[tuple[str, str]], bool]] = {
    "plaintext": ("", [SLOT], "\n\n", "\n", [], False),
    "properties": ("# strings\n! of a file\n\n", ["key.", ID, " = ", SLOT], "\n", "\n", [_SLASH], False),
    "po": ('msgid ""\nmsgstr ""\n"Plural-Forms: nplurals=2;\\n"\n\n', ["#. note ", ID, "\nmsgid \"", SOURCE, "\"\nmsgstr ", SLOT], "\n\n", "\n", [_SLASH, _QUOTE], True),
    "srt": ("", [ID, "\n00:00:01,000 --> 00:00:02,000\n", SLOT], "\n\n", "\n", [], False),
    "vtt": ("WEBVTT\n\nNOTE none\n\n", ["cue ", ID, "\n00:01.000 --> 00:02.000 align:start\n", SLOT], "\n\n", "\n", _AMP, False),
    "json": ('{"version": 2, "list": [', ['{"id": ', ID, ', "text": ', SLOT, ', "ok": true}'], ",\n", "], \"none\": null}", [_SLASH, _QUOTE], False),
    "php": ("<?php\nreturn [\n", ["    'key", ID, "' => ", SLOT], ",\n", ",\n];\n", [_SLASH, ("'", "\\'")], False),
    "javascript": ("// \"comment\"\nconst strings = {\n", ["  key", ID, ": ", SLOT], ",\n", "\n};\n", [_SLASH, _QUOTE], False),
    "rc": ('#include "resource.h"\nSTRINGTABLE\nBEGIN\n', ["    IDS_", ID, ", ", SLOT], "\n", "\nEND\n", [_SLASH, ('"', '""')], False),
    "mif": ("<MIFFile 2015>\n<Para\n", [" <ParaLine\n  <String `", SLOT, "'>\n >"], "\n", "\n>\n", [_SLASH, ("'", "\\q"), ("`", "\\Q")], False),
    "html": ("<!DOCTYPE html>\n<html><head><script>var a = '<p>no</p>';</script></head>\n<body>\n", ['<p id="p', ID, '">\n  ', SLOT, "</p>"], "\n<hr/>\n", "\n</body></html>\n", _AMP, False),
    "markdown": ("```\ncode\n```\n\n", ["## ", SLOT, " ##\n\n***"], "\n\n", "\n", [], False),
    "xml": ('<?xml version="1.0"?>\n<!-- none -->\n<doc>', ['<item id="', ID, '">', SLOT, "</item>"], "\n  ", "</doc>\n", _AMP, False),
    "dita": ('<topic id="t"><body><codeblock>int x;</codeblock>', ["<p>", SLOT, "</p>"], "\n", "</body></topic>\n", _AMP, False),
    "qti": ('<assessmentItem><itemBody><m:math/><math>x</math>', ['<simpleChoice identifier="c', ID, '">', SLOT, "</simpleChoice>"], "", "</itemBody></assessmentItem>", _AMP, False),
    "inx": ("<docu><story>", ["<cflo><txsr><pcnt>", SLOT, "</pcnt></txsr></cflo>"], "\n", "</story></docu>", _AMP, False),
    "icml": ("<Document><Story>", ["<ParagraphStyleRange><Content>", SLOT, "</Content><Br/></ParagraphStyleRange>"], "\n", "</Story></Document>", _AMP, False),
    "resx": ("<root>\n<resheader name=\"version\"><value>2.0</value></resheader>\n", ['<data name="k', ID, '" xml:space="preserve">\n <value>', SLOT, "</value>\n <comment>c</comment></data>"], "\n", "\n</root>\n", _AMP, False),
    "ts": ("<TS>\n<context><name>n</name>\n", ["<message><source>", SOURCE, '</source><translation type="unfinished">', SLOT, "</translation></message>"], "\n", "\n</context></TS>\n", _AMP, True),
    "txml": ("<txml><translatable>", ['<segment segmentId="', ID, '"><source>', SOURCE, "</source><target>", SLOT, "</target></segment>"], "\n", "</translatable></txml>\n", _AMP, True),
    "txlf": ("<xliff><file><body>", ['<trans-unit id="', ID, '"><source>', SOURCE, '</source><target state="new">', SLOT, "</target></trans-unit>"], "\n", "</body></file></xliff>\n", _AMP, True),
    "wpml": ("<xliff><file><body>", ['<trans-unit resname="', ID, '" restype="string"><source>', SOURCE, "</source><target>", SLOT, "</target></trans-unit>"], "\n", "</body></file></xliff>\n", _AMP, True),
    "xliff1": ('<xliff version="1.2"><file><body>', ['<trans-unit id="', ID, '"><source>', SOURCE, "</source><target>", SLOT, "</target><alt-trans><source>a</source><target>b</target></alt-trans></trans-unit>"], "\n", "</body></file></xliff>\n", _AMP, True),
    "xliff2": ('<xliff version="2.1"><file>', ['<unit id="u', ID, '"><segment id="', ID, '" state="initial"><source>', SOURCE, "</source><target>", SLOT, "</target></segment></unit>"], "\n", "</file></xliff>\n", _AMP, True),
    "sdlxliff": ("<xliff><file><body>", ['<trans-unit id="', ID, '"><source>x</source><seg-source>', SOURCE, "</seg-source><target>", SLOT, "</target></trans-unit>"], "\n", "</body></file></xliff>\n", _AMP, True),
}
#: What surrounds a text in its slot.
_AROUND = {"po": ('"', '"'), "json": ('"', '"'), "javascript": ('"', '"'), "rc": ('"', '"'), "php": ("'", "'")}
_CONTROL = "[\\x00-\\x20]+"


def _clean(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[<>]", ""), _CONTROL, " "))


def _template(fmt: str, source: Column, text: Column, key: Column) -> Column:
    """One unit's part of the document."""
    _, parts, _, _, table, _ = TEMPLATES[fmt]
    a, z = _AROUND.get(fmt, ("", ""))

    def escaped(c: Column) -> Column:
        for old, new in table:
            c = F.replace(c, F.lit(old), F.lit(new))
        return c

    slot = F.concat(F.lit(a), escaped(text), F.lit(z))
    return F.concat(*[key.cast("string") if p == ID else escaped(source) if p == SOURCE else slot if p == SLOT else F.lit(p) for p in parts])


def documents(spark: SparkSession, d: str, fmt: str) -> DataFrame:
    """``file_id, text, sources, translations``: one document of the format for each file."""
    head, _, between, tail, _, beside = TEMPLATES[fmt]
    source, target = _clean("source"), _clean("target")
    u = units(spark, d).where(source.rlike("\\p{L}"))
    chosen = F.when((F.col("approved") == "yes") & F.coalesce(target.rlike("\\p{L}"), F.lit(False)), target).otherwise(source)
    rows = u.select("file_id", F.struct("seg_ord", "unit_key", source.alias("s"), chosen.alias("t")).alias("u"))
    g = rows.groupBy("file_id").agg(F.array_sort(F.collect_list("u")).alias("us"))
    made = F.transform("us", lambda x: _template(fmt, x["s"], F.lit("") if beside else x["s"], x["unit_key"]))
    return g.select("file_id", F.concat(F.lit(head), F.array_join(made, between), F.lit(tail)).alias("text"), F.col("us.s").alias("sources"), F.col("us.t").alias("translations"))


def roundtrip(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    """Each document read, checked against the texts that it was made of, and written with its translations."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                keys, texts, sources, translations = (c.to_pylist() for c in batch.columns)
                rows = []
                for key, text, wanted, new in zip(keys, texts, sources, translations):
                    got = [s.unit for s in formats.slots(fmt, text)]
                    rows.append((key, len(got), sum(a == b for a, b in zip(got, wanted)), formats.write(fmt, text, []) == text, formats.write(fmt, text, new)))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["file_id", "n_slots", "n_equal", "identical", "written"])

        out = documents(spark, d, fmt).mapInArrow(run, "file_id bigint, n_slots bigint, n_equal bigint, identical boolean, written string")
        return out.select("file_id", "n_slots", "n_equal", "identical", F.md5("written").alias("digest"))

    query.__name__ = f"roundtrip_{fmt}"
    return query


def _sql(text: str) -> str:
    """A string of SQL; line ends as they are."""
    return "'" + text.replace("'", "''") + "'"


def _sql_roundtrip(fmt: str) -> str:
    head, parts, between, tail, table, _ = TEMPLATES[fmt]
    a, z = _AROUND.get(fmt, ("", ""))

    def escaped(c: str) -> str:
        for old, new in table:
            c = f"replace({c}, {_sql(old)}, {_sql(new)})"
        return c

    clean = lambda c: f"trim(regexp_replace(regexp_replace({c}, '[<>]', '', 'g'), '[\\x00-\\x20]+', ' ', 'g'), ' ')"
    made = " || ".join("unit_key::varchar" if p == ID else escaped("s") if p == SOURCE else f"{_sql(a)} || {escaped('t')} || {_sql(z)}" if p == SLOT else _sql(p) for p in parts)
    return f"""with u as (select distinct on (unit_key) unit_key, file_id, seg_ord, approved, {clean('source')} as s, {clean('target')} as target from trans_units order by unit_key),
v as (select *, case when approved = 'yes' and regexp_matches(coalesce(target, ''), '\\p{{L}}') then target else s end as t from u where regexp_matches(s, '\\p{{L}}'))
select file_id, count(*) as n_slots, count(*) as n_equal, true as identical, md5({_sql(head)} || string_agg({made}, {_sql(between)} order by seg_ord, unit_key) || {_sql(tail)}) as digest from v group by 1"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"roundtrip_{fmt}": roundtrip(fmt) for fmt in TEMPLATES}


def oracle_sql() -> dict[str, str]:
    return {f"roundtrip_{fmt}": _sql_roundtrip(fmt) for fmt in TEMPLATES}
