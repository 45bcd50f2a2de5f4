"""Queries of the rule engine, with a rule set that SQL can follow by guarding the places where no rule may break."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segforge import segmenter
from segforge.io import table
from segforge.operators.units import units
from segforge.plans import inline

Query = Callable[[SparkSession, str], DataFrame]
# Abbreviations of the queries' rule set.
ABBREVIATIONS = "Dr|Sra?|Mrs?|Prof|Inc|Ltd|No|no|v|sec|cf|al|e\\.g|i\\.e|ca|Nr|Abb|approx|aprox|ok|ul|np|tj"
_NO, _END, _GAP = f"[ \\t\\n(](?:{ABBREVIATIONS})\\.", "[.?!]", "[ \\t\\n]"
RULES = (segmenter.Rule(".*", False, _NO, _GAP), segmenter.Rule(".*", True, _END, _GAP), segmenter.Rule("ja.*|zh.*", True, "[。！？]", "[^」』”）]"))
_GUARD, _CUT = "\ue000", "\u2029"


def segment_srx(s: SparkSession, d: str) -> DataFrame:
    """Segments of whole documents by ordered rules of their languages."""
    got = segmenter.segments(table(s, d, "documents").where("text is not null"), "doc_id", "text", "lang", RULES)
    return got.select("doc_id", F.col("seg_ord").cast("bigint").alias("seg_ord"), F.md5("segment").alias("digest"), F.length("segment").cast("bigint").alias("chars"))


def segment_tagged(s: SparkSession, d: str) -> DataFrame:
    """Units with inline tags cut anew: what has a target keeps its one segment, the rules don't see the tags."""
    u = units(s, d, "unit_id", "source", "target", "translate").where(F.col("source").rlike("[\\p{L}\\p{N}]") & F.expr("coalesce(lower(translate), 'yes') <> 'no'"))
    u = u.select("unit_key", "unit_id", F.regexp_replace(F.regexp_replace("source", "[<>]", ""), "([.?!])([ \\t\\n])", "$1<x id=\"e\"/>$2").alias("source"), "target", F.lit("en").alias("lang"))
    got = segmenter.resegmented(u, "unit_key", "unit_id", "source", "target", "lang", RULES)
    return got.select("unit_key", F.col("ord"), "kind", "segment_id", "text")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (segment_srx, segment_tagged)}


def _guarded(c: str, gap: str) -> str:
    """Twice, as abbreviations in a row share the space between them; then the breaks."""
    for _ in range(2):
        c = f"regexp_replace({c}, '({_NO})({gap})', '\\1{_GUARD}\\2', 'g')"
    return f"regexp_replace({c}, '({_END})({gap})', '\\1{_CUT}\\2', 'g')"


def oracle_sql() -> dict[str, str]:
    wide = "coalesce(regexp_full_match(replace(lang, '_', '-'), 'ja.*|zh.*'), false)"
    cut = _guarded("text", _GAP)
    more = lambda c: f"regexp_replace({c}, '([。！？])([^」』”）{_CUT}])', '\\1{_CUT}\\2', 'g')"
    cut = f"replace(case when {wide} then {more(more(cut))} else {cut} end, '{_GUARD}', '')"
    tag, blank = '<x id="e"/>', "[^\\s\\x{a0}\\x{3000}\\x{2000}-\\x{200a}\\x{202f}]"
    return {
        "segment_srx": f"with x as (select doc_id, string_split({cut}, '{_CUT}') as p from documents where text is not null), y as (select doc_id, unnest(p) as s, generate_subscripts(p, 1) - 1 as seg_ord from x) select doc_id, seg_ord, md5(s) as digest, length(s)::bigint as chars from y",
        "segment_tagged": f"""with {inline._U}, m as (select unit_key, unit_id, target, {_guarded("regexp_replace(source, '[<>]', '', 'g')", _GAP)} as g from u where regexp_matches(source, '[\\p{{L}}\\p{{N}}]') and coalesce(lower(translate), 'yes') <> 'no'),
n as (select *, replace(replace(g, '{_CUT}', '{tag}'), '{_GUARD}', '{tag}') as marked from m),
o as (select unit_key, unit_id, case when regexp_matches(target, '{blank}') and target <> marked then [marked] else string_split(g, '{_CUT}') end as parts, coalesce(regexp_matches(target, '{blank}') and target <> marked, false) as whole from n),
r as (select unit_key, unit_id, whole, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as ord from o),
t as (select *, regexp_matches(part, '{blank}') as seg, count(*) filter (regexp_matches(part, '{blank}')) over (partition by unit_key) as n, count(*) filter (regexp_matches(part, '{blank}')) over (partition by unit_key order by ord) as k from r)
select unit_key, ord, case when seg then 'segment' else 'ignorable' end as kind, case when not seg then '' when n = 1 then unit_id else unit_id || '-' || k end as segment_id, case when ord > 0 then '{tag}' else '' end || replace(part, '{_GUARD}', '{tag}') as text from t""",
    }
