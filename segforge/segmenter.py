"""Rule-based segmentation: ordered break and no-break rules, each a pattern before and one after a position.

Rules come as data (a rule file in the public exchange format, or a table). A position can only break if a break rule
fits, so break rules are tried first and the ordered list is consulted only there; patterns are compiled once a task.
No character is lost: the segments of a text joined give the text.

Defined results: null gives no segments, empty text one empty segment, blank text is kept whole.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``language`` is a pattern that the whole tag must match."""

    language: str
    breaks: bool
    before: str
    after: str


# A small default set; callers bring their own for production.
ABBREVIATIONS = "Dr|Mr|Mrs|Ms|Prof|Sr|Sra|St|vs|etc|approx|fig|no|Nr|Abb|ca|usw|bzw|e\\.g|i\\.e|z\\. ?B|p\\. ?ej|p\\. ?ex|cf|al|Jan|Feb|Inc|Ltd|Co|Corp|pág|núm|рис|прим|проф|см"
DEFAULT = (
    Rule(".*", False, rf"\b(?:{ABBREVIATIONS})\.", r"\s"),
    Rule(".*", False, r"\b[A-ZА-Я]\.", r"\s"),
    Rule(".*", False, r"(?:^|\n)\s*\d{1,3}\.", r"\s"),
    Rule(".*", True, r"[.?!…]+[\"'”’»)\]]*", r"\s+\S"),
    Rule(".*", True, r"[。！？][」』”）]*", ""),
    Rule("hi.*", True, r"।", r""),
    Rule("th.*", True, r"[\u0e00-\u0e7f]", r"\s[\u0e00-\u0e7f]"),
    Rule(".*", True, r"\u2029", r""),
)


def read_rules(xml: str) -> tuple[Rule, ...]:
    """Rules of a rule file; all maps that fit a language apply, in the order of the rule sets."""
    root = ET.fromstring(xml)
    local = lambda e: e.tag.rpartition("}")[2]
    maps = [(e.get("languagepattern"), e.get("languagerulename")) for e in root.iter() if local(e) == "languagemap"]
    out = []
    for group in (e for e in root.iter() if local(e) == "languagerule"):
        languages = "|".join(f"(?:{p})" for p, name in maps if name == group.get("languagerulename"))
        for rule in (e for e in group if local(e) == "rule"):
            parts = {local(p): p.text or "" for p in rule}
            if languages:
                out.append(Rule(languages, rule.get("break", "yes") != "no", parts.get("beforebreak", ""), parts.get("afterbreak", "")))
    return tuple(out)


@lru_cache(maxsize=64)
def compiled(rules: tuple[Rule, ...], lang: str) -> list[tuple]:
    """(breaks, before, after) of the rules of a language. Patterns before a place run backwards from it, so they look at no more
    text than they match; rules in a row with one pattern after the place are tried together."""
    chosen: list[list] = []
    for r in rules:
        if not re.fullmatch(r.language, lang):
            continue
        if chosen and chosen[-1][0] == r.breaks and chosen[-1][2] == r.after and r.before and chosen[-1][1]:
            chosen[-1][1].append(r.before)
        else:
            chosen.append([r.breaks, [r.before] if r.before else [], r.after])
    pattern = lambda parts: regex.compile("(?r)" + "|".join(f"(?:{p})" for p in parts)) if parts else None
    return [(breaks, pattern(before), regex.compile(after) if after else None) for breaks, before, after in chosen]


def segment(text: str | None, lang: str | None, rules: tuple[Rule, ...] = DEFAULT) -> list[str]:
    """Segments of a text of any length. What precedes a place is looked at from the segment's beginning on."""
    if text is None:
        return []
    table = compiled(rules, lang or "")
    places: set[int] = set()
    for breaks, before, after in table:
        if breaks:
            places |= {m.end() for m in before.finditer(text, overlapped=True)} if before else {m.start() for m in after.finditer(text, overlapped=True)} if after else set()
    out, start = [], 0
    for i in sorted(places):
        if not start < i < len(text):
            continue
        for breaks, before, after in table:
            if (before is None or before.match(text, start, i)) and (after is None or after.match(text, i)):
                if breaks:
                    out.append(text[start:i])
                    start = i
                break
    out.append(text[start:])
    return out


_INLINE = re.compile(r"<(ph|bpt|ept|it)\b[^>]*(?<!/)>.*?</\1>|<[^>]*>", re.S)


def segment_tagged(text: str | None, lang: str | None, rules: tuple[Rule, ...] = DEFAULT) -> list[str]:
    """Segments of a text with inline tags, which the rules don't see. Tags at a place where the text breaks begin the next segment; joined,
    the segments give the text."""
    if text is None:
        return []
    tags = list(_INLINE.finditer(text))
    if not tags:
        return segment(text, lang, rules)
    plain, starts, at = [], [], 0  # places of the plain text's characters in the whole
    for m in [*tags, None]:
        end = m.start() if m else len(text)
        plain.append(text[at:end])
        starts += range(at, end)
        at = m.end() if m else end
    out, seen, begin = [], 0, 0
    parts = segment("".join(plain), lang, rules)
    for part in parts[:-1]:
        seen += len(part)
        cut = starts[seen - 1] + 1
        out.append(text[begin:cut])
        begin = cut
    return [*out, text[begin:]]


def seg_source(text: str, lang: str | None, rules: tuple[Rule, ...] = DEFAULT) -> str:
    """A text as markers with numbers."""
    return "".join(f'<mrk mtype="seg" mid="{i}">{part}</mrk>' for i, part in enumerate(segment_tagged(text, lang, rules)))


_EDGE = re.compile(r"<[^>]*>\s*|\s+")


def resegment(unit_id: str, source: str, target: str | None, lang: str | None, rules: tuple[Rule, ...] = DEFAULT) -> list[tuple[str, str, str]]:
    """(kind, id, text) of a unit that is cut anew: kinds are segment and ignorable (tags alone at the edges). A unit that has a target
    of its own, or that gives one segment, keeps its id."""
    if target is not None and target.strip() and target != source:
        return [("segment", unit_id, source)]
    out = []
    parts = segment_tagged(source, lang, rules)
    n = 0
    for part in parts:
        if not _INLINE.sub("", part).strip():
            out.append(("ignorable", "", part))
        else:
            n += 1
            out.append(("segment", f"{unit_id}-{n}", part))
    return [(kind, unit_id if kind == "segment" and n == 1 else i, part) for kind, i, part in out]


def resegmented(df: DataFrame, key: str, unit_id: str, source: str, target: str, lang: str, rules: tuple[Rule, ...] = DEFAULT) -> DataFrame:
    """``key, ord, kind, segment_id, text`` of all units."""

    def run(batches):
        for batch in batches:
            rows = [(k, i, *x) for k, u, s, t, g in zip(*(c.to_pylist() for c in batch.columns)) if s is not None for i, x in enumerate(resegment(u or "", s, t, (g or "").replace("_", "-"), rules))]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=[key, "ord", "kind", "segment_id", "text"])

    return df.select(F.col(key).cast("bigint"), unit_id, source, target, lang).mapInArrow(run, f"{key} bigint, ord bigint, kind string, segment_id string, text string")


def segments(df: DataFrame, key: str, text: str, lang: str, rules: tuple[Rule, ...] = DEFAULT) -> DataFrame:
    """``key, seg_ord, segment`` of every text, in one pass without shuffle."""

    def run(batches):
        for batch in batches:
            rows = [(k, i, s) for k, t, g in zip(*(c.to_pylist() for c in batch.columns)) for i, s in enumerate(segment(t, (g or "").replace("_", "-"), rules))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=[key, "seg_ord", "segment"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text, lang).mapInArrow(run, f"`{key}` {kind}, seg_ord int, segment string")
