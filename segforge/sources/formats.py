"""Text formats as pieces: what stays as it is, and slots that hold the texts to translate.

``pieces`` cuts a document of a format into raw strings and slots; the raw strings are its skeleton, kept as a list and never as
marked-up text, so nothing in a document can be taken for a placeholder. ``write`` puts the pieces together again: a slot
without translation keeps its spelling, so that reading and writing without translations gives the same bytes.

Defined results: null documents have no pieces; a document in which nothing matches is one raw piece. A translation is encoded by the
rules of its format. Bilingual formats keep the source and have their slot at the target.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slot:
    """A place for a text: its spelling, its text, for bilingual formats the source, and the name and note that go with it."""

    raw: str
    text: str
    source: str | None = None
    name: str | None = None
    note: str | None = None
    approved: bool | None = None

    @property
    def unit(self) -> str:
        return self.text if self.source is None else self.source


Piece = str | Slot
_XML_TEXT = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]


def _replaced(text: str, table: list[tuple[str, str]]) -> str:
    for a, b in table:
        text = text.replace(a, b)
    return text


def to_xml(text: str) -> str:
    return _replaced(text, _XML_TEXT)


def from_xml(text: str) -> str:
    """Character references and the entities of the markup; CDATA sections give their content."""
    out, at = [], 0
    for m in re.finditer(r"<!\[CDATA\[(.*?)\]\]>", text, re.S):
        out += [html.unescape(text[at : m.start()]), m.group(1)]
        at = m.end()
    return "".join([*out, html.unescape(text[at:])])


def _escapes(text: str, table: dict[str, str], wide: str = "u") -> str:
    r"""Backslash escapes; ``\uXXXX`` are code units."""
    plain = re.sub(rf"\\({wide})([0-9A-Fa-f]{{4}})|\\(.)", lambda m: chr(int(m.group(2), 16)) if m.group(2) else table.get(m.group(3), m.group(3)), text, flags=re.S)
    return plain.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in plain) else plain


_C = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "0": "\0"}


def _by(pattern: re.Pattern, text: str, slot: Callable[[re.Match], Slot | None], group: str = "t") -> Iterator[Piece]:
    """Pieces of a text in which a group of each match is a slot."""
    at = 0
    for m in pattern.finditer(text):
        made = slot(m)
        if made is not None:
            yield text[at : m.start(group)]
            yield made
            at = m.end(group)
    yield text[at:]


# properties --------------------------------------------------------------------------------------------------------

_PROPERTY = re.compile(r"^[ \t\f]*(?P<k>(?:[^#!\s=:\\]|\\.)(?:[^\s=:\\]|\\.)*)[ \t\f]*[=: \t\f][ \t\f]*(?P<t>(?:[^\\\n]|\\.)*)$", re.M | re.S)


def properties(text: str) -> Iterator[Piece]:
    def value(raw: str) -> str:
        return _escapes(re.sub(r"\\\r?\n[ \t\f]*", "", raw), {**_C, "0": "0"})

    def note(m: re.Match) -> str | None:
        lines = text[: m.start()].split("\n")[:-1]
        kept = []
        while lines and lines[-1].lstrip()[:1] in ("#", "!"):
            kept.append(lines.pop().lstrip()[1:].strip())
        return "\n".join(reversed(kept)) or None

    return _by(_PROPERTY, text, lambda m: Slot(m["t"], value(m["t"]), name=_escapes(m["k"], _C), note=note(m)))


def to_properties(text: str) -> str:
    out = _replaced(text, [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f")])
    return "\\" + out if out[:1] == " " else out


# messages (gettext) ------------------------------------------------------------------------------------------------

_QUOTED = r'"(?:[^"\\\n]|\\.)*"'
_MANY = rf"{_QUOTED}(?:\s*\n{_QUOTED})*"
_MESSAGE = re.compile(rf'^(?P<notes>(?:#[^\n]*\n)*)(?:msgctxt\s+(?P<c>{_MANY})\s*\n)?msgid\s+(?P<s>{_MANY})\s*\n(?:msgid_plural\s+(?P<p>{_MANY})\s*\n)?(?P<targets>(?:msgstr(?:\[\d+\])?\s+{_MANY}\s*?(?:\n|$))+)', re.M)
_MSGSTR = re.compile(rf"msgstr(?:\[(?P<n>\d+)\])?\s+(?P<t>{_MANY})")


def from_po(raw: str) -> str:
    return _escapes("".join(x[1:-1] for x in re.findall(_QUOTED, raw)), _C)


def to_po(text: str) -> str:
    return '"' + _replaced(text, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")]) + '"'


def po(text: str) -> Iterator[Piece]:
    """One slot a form; the header's form count isn't needed, every form that is written is one. The header is raw."""
    at = 0
    for m in _MESSAGE.finditer(text):
        source, plural = from_po(m["s"]), from_po(m["p"]) if m["p"] else None
        if not source:
            continue
        fuzzy = bool(re.search(r"^#,.*\bfuzzy\b", m["notes"], re.M))
        note = "\n".join(x[2:].strip() for x in m["notes"].splitlines() if x[:2] in ("# ", "#.")) or None
        for form in _MSGSTR.finditer(text, m.start("targets"), m.end("targets")):
            yield text[at : form.start("t")]
            target = from_po(form["t"])
            own = source if plural is None or form["n"] in (None, "0") else plural
            yield Slot(form["t"], target, own, name=from_po(m["c"]) if m["c"] else None, note=note, approved=bool(target) and not fuzzy)
            at = form.end("t")
    yield text[at:]


def plural_forms(text: str) -> int:
    """Number of forms that the header names; 0 without one."""
    m = re.search(r"nplurals\s*=\s*(\d+)", text)
    return int(m.group(1)) if m else 0


# subtitles ---------------------------------------------------------------------------------------------------------

_TIME = r"(?:\d+:)?\d\d:\d\d[.,]\d{3}"
_SRT = re.compile(rf"^[ \t]*(?P<i>\d+)[ \t]*\n(?P<w>{_TIME} --> {_TIME}[^\n]*)\n(?P<t>(?:[^\n]+(?:\n|$))*?[^\n]+)(?=\n[ \t]*(?:\n|$)|\n?$(?![\s\S]))", re.M)
_VTT = re.compile(rf"^(?:(?P<i>(?!NOTE|STYLE|REGION|WEBVTT)[^\n]*\S[^\n]*)\n)?(?P<w>{_TIME} --> {_TIME}[^\n]*)\n(?P<t>(?:[^\n]+(?:\n|$))*?[^\n]+)(?=\n[ \t]*(?:\n|$)|\n?$(?![\s\S]))", re.M)


def srt(text: str) -> Iterator[Piece]:
    return _by(_SRT, text, lambda m: Slot(m["t"], m["t"], name=m["i"], note=m["w"]))


def vtt(text: str) -> Iterator[Piece]:
    """The note is the time line and, on a line of its own, the speaker."""

    def slot(m: re.Match) -> Slot:
        speaker = re.search(r"<v[ .][^>]*?([^>.]+)>", m["t"])
        return Slot(m["t"], html.unescape(m["t"]), name=m["i"], note=m["w"] + (f"\n{speaker.group(1).strip()}" if speaker else ""))

    return _by(_VTT, text, slot)


# program texts -----------------------------------------------------------------------------------------------------

_JSON = re.compile(r'(?P<t>"(?:[^"\\]|\\.)*")(?P<k>\s*:)?', re.S)
_PHP = re.compile(r"""(?:(?P<k>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\d+)\s*\]?\s*=>?\s*)(?P<t>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")""", re.S)
_JS = re.compile(r"""(?P<c>//[^\n]*|/\*.*?\*/)|(?:(?P<k>[\w$]+|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")\s*[:=]\s*)(?P<t>'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")""", re.S)
_RC = re.compile(r'^(?P<x>\s*(?:#|//)[^\n]*$)|(?P<t>"(?:[^"\n]|"")*")', re.M)


def from_json(raw: str) -> str:
    try:
        return json.loads(raw, strict=False)
    except ValueError:
        return raw[1:-1]


def json_strings(text: str) -> Iterator[Piece]:
    """String values at any depth; names are raw, and so are numbers, literals and empty strings."""
    return _by(_JSON, text, lambda m: None if m["k"] or m["t"] == '""' else Slot(m["t"], from_json(m["t"])))


def to_json(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _from_quotes(raw: str) -> str:
    body = raw[1:-1]
    return re.sub(r"\\(['\\])", r"\1", body) if raw[0] == "'" else _escapes(body, {**_C, "$": "$"})


def php(text: str) -> Iterator[Piece]:
    """Values of arrays."""
    return _by(_PHP, text, lambda m: Slot(m["t"], _from_quotes(m["t"]), name=m["k"].strip("'\"")))


def to_php(text: str) -> str:
    return "'" + _replaced(text, [("\\", "\\\\"), ("'", "\\'")]) + "'"


def javascript(text: str) -> Iterator[Piece]:
    """Values of properties and variables; comments are raw."""
    return _by(_JS, text, lambda m: None if m["c"] else Slot(m["t"], _escapes(m["t"][1:-1], _C), name=m["k"].strip("'\"")))


def to_javascript(text: str) -> str:
    return '"' + _replaced(text, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]) + '"'


def rc(text: str) -> Iterator[Piece]:
    """Strings of resource scripts, but not of lines for the preprocessor."""
    return _by(_RC, text, lambda m: None if m["x"] is not None or m["t"] == '""' else Slot(m["t"], _replaced(m["t"][1:-1].replace('""', '"'), [("\\n", "\n"), ("\\t", "\t"), ("\\\\", "\\")])))


def to_rc(text: str) -> str:
    return '"' + _replaced(text, [("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ('"', '""')]) + '"'


def mif(text: str) -> Iterator[Piece]:
    """Strings of text lines."""

    def value(raw: str) -> str:
        known = {"t": "\t", "q": "'", "Q": "`", ">": ">", "\\": "\\"}
        return re.sub(r"\\x([0-9a-fA-F]{2}) |\\(.)", lambda m: chr(int(m.group(1), 16)) if m.group(1) else known.get(m.group(2), m.group(2)), raw)

    return _by(re.compile(r"<String `(?P<t>[^']+)'>"), text, lambda m: Slot(m["t"], value(m["t"])))


def to_mif(text: str) -> str:
    return _replaced(text, [("\\", "\\\\"), ("\t", "\\t"), ("'", "\\q"), ("`", "\\Q"), (">", "\\>")])


# markup ------------------------------------------------------------------------------------------------------------

# Elements that part text, and elements whose content is none.
BLOCKS = "address|article|aside|blockquote|body|br|button|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|meta|nav|noframes|noscript|ol|optgroup|option|p|param|pre|section|select|source|summary|table|tbody|td|template|textarea|tfoot|th|thead|title|tr|track|ul"
_BLOCK = re.compile(rf"<!--.*?-->|<(script|style|code)\b[^>]*>.*?</\1\s*>|<[!?][^>]*>|</?(?:{BLOCKS})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.I | re.S)
_SPACE = " \t\r\n\f"


def _run(raw: str, decode: Callable[[str], str]) -> Iterator[Piece]:
    """A run of text: its outer white space is raw; without letters or digits outside tags it is raw altogether."""
    body = raw.strip(_SPACE)
    if not any(c.isalnum() for c in re.sub(r"<[^>]*>|&[#\w]+;", "", body)):
        yield raw
        return
    lead = raw[: len(raw) - len(raw.lstrip(_SPACE))]
    yield lead
    yield Slot(body, decode(body))
    yield raw[len(lead) + len(body) :]


def from_html(raw: str) -> str:
    """Entities outside tags, white space as one space."""
    parts = re.split(r"(<[^>]*>)", re.sub(r"[ \t\r\n\f]+", " ", raw))
    return "".join(p if p[:1] == "<" else html.unescape(p) for p in parts)


def to_html(text: str) -> str:
    """Text with inline tags: only what is no tag is encoded."""
    parts = re.split(r"(</?[A-Za-z][^<>]*>)", text)
    return "".join(p if i % 2 else _replaced(p, _XML_TEXT) for i, p in enumerate(parts))


def html_blocks(text: str) -> Iterator[Piece]:
    """Runs of text between elements that part it; inline elements stay in the text."""
    at = 0
    for m in _BLOCK.finditer(text):
        yield from _run(text[at : m.start()], from_html)
        yield m.group()
        at = m.end()
    yield from _run(text[at:], from_html)


_MD_SKIP = re.compile(r"^(?:```|~~~)[^\n]*\n(?:.*?\n)?(?:```|~~~)[ \t]*$|^(?: {4}|\t)[^\n]*$|^[ \t]*(?:[-*_][ \t]*){3,}$|^[=-]+[ \t]*$|^\|?[ \t]*:?-{2,}:?[ \t|:\-]*$|^\[[^\]\n]+\]:[^\n]*$|^<!--.*?-->$", re.M | re.S)
_MD_LEAD = re.compile(r"^[ \t]*(?:>[ \t]?|[-+*][ \t]+(?:\[[ xX]\][ \t]+)?|\d{1,9}[.)][ \t]+)*(?:#{1,6}[ \t]+)?")


def markdown(text: str) -> Iterator[Piece]:
    """Headings, items, quotes, cells and paragraphs (lines in a row); code, rules and definitions are raw."""

    def prose(part: str) -> Iterator[Piece]:
        held: list[str] = []

        def flush() -> Iterator[Piece]:
            if held:
                yield from _run("".join(held), lambda x: re.sub(r"[ \t]*\n[ \t]*", " ", x))
                held.clear()

        for line in re.findall(r"[^\n]*\n|[^\n]+", part):
            body = line.rstrip("\r\n")
            lead = _MD_LEAD.match(body).group()
            if body.lstrip()[:1] == "|":
                yield from flush()
                for cell in re.split(r"((?<!\\)\|)", body):
                    if cell == "|":
                        yield cell
                    else:
                        yield from _run(cell, str)
                yield line[len(body) :]
            elif lead.strip() or not body.strip():
                yield from flush()
                yield lead
                rest = body[len(lead) :]
                if "#" in lead:
                    close = re.search(r"[ \t]+#+[ \t]*$", rest)
                    yield from _run(rest[: close.start()] if close else rest, str)
                    yield (close.group() if close else "") + line[len(body) :]
                else:
                    held.append(rest + line[len(body) :])
            else:
                held.append(line)
        yield from flush()

    at = 0
    for m in _MD_SKIP.finditer(text):
        yield from prose(text[at : m.start()])
        yield m.group()
        at = m.end()
    yield from prose(text[at:])


def xml_texts(inline: tuple[str, ...] = (), ignored: tuple[str, ...] = ()) -> Callable[[str], Iterator[Piece]]:
    """Reader of any markup: runs of text between tags, other than the inline ones; the content of ignored elements is raw."""
    skip = "|".join([r"<!--.*?-->", r"<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>", r"<\?.*?\?>"] + [rf"<{re.escape(x)}(?=[\s>])[^>]*(?<!/)>.*?</{re.escape(x)}\s*>" for x in ignored])
    inner = rf"(?!/?(?:{'|'.join(map(re.escape, inline))})[\s/>])" if inline else ""
    border = re.compile(rf"{skip}|<{inner}/?[A-Za-z_](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)

    def read(text: str) -> Iterator[Piece]:
        at = 0
        for m in border.finditer(text):
            yield from _run(text[at : m.start()], from_xml)
            yield m.group()
            at = m.end()
        yield from _run(text[at:], from_xml)

    return read


def elements(name: str) -> Callable[[str], Iterator[Piece]]:
    """Reader of the content of one element, as packages' members have it."""
    pattern = re.compile(rf"<{name}(?:\s[^>]*)?(?<!/)>(?P<t>[^<]*(?:<!\[CDATA\[.*?\]\]>[^<]*)*)</{name}>", re.S)
    return lambda text: _by(pattern, text, lambda m: Slot(m["t"], from_xml(m["t"])) if m["t"].strip() else None)


def resx(text: str) -> Iterator[Piece]:
    pattern = re.compile(r'<data\s[^>]*?name="(?P<k>[^"]*)"(?![^>]*\s(?:type|mimetype)=)[^>]*>\s*<value>(?P<t>[^<]*)</value>(?:\s*<comment>(?P<n>[^<]*)</comment>)?', re.S)
    return _by(pattern, text, lambda m: Slot(m["t"], from_xml(m["t"]), name=from_xml(m["k"]), note=m["n"] and from_xml(m["n"])) if m["t"].strip() else None)


def bilingual(unit: str, source: str = "source", target: str = "target", key: str | None = None, approved: Callable[[str, str], bool] | None = None) -> Callable[[str], Iterator[Piece]]:
    """Reader of formats in which an element holds a source and a target; ``approved`` tells by the tags of unit and target."""
    outer = re.compile(rf"(?P<u><{unit}(?:\s[^>]*)?(?<!/)>)(?P<b>(?:(?!<{unit}[\s>]).)*?)</{unit}>", re.S)
    one = re.compile(rf"<{source}(?:\s[^>]*)?(?<!/)>(?P<s>.*?)</{source}>", re.S)
    two = re.compile(rf"(?P<g><{target}(?:\s[^>]*)?(?<!/)>)(?P<t>.*?)</{target}>", re.S)

    def read(text: str) -> Iterator[Piece]:
        at = 0
        for m in outer.finditer(text):
            body = re.sub(r"<(alt-trans|matches|mtc:matches)[\s>].*?</\1>", lambda x: " " * len(x.group()), m["b"], flags=re.S)
            s, t = one.search(body), two.search(body)
            if not s or not t:
                continue
            start, end = m.start("b") + t.start("t"), m.start("b") + t.end("t")
            name = re.search(rf'\s{key}="([^"]*)"', m["u"]) if key else None
            yield text[at:start]
            yield Slot(text[start:end], from_xml(text[start:end]), from_xml(s["s"]), name=from_xml(name.group(1)) if name else None, approved=approved(m["u"], t["g"]) if approved else None)
            at = end
        yield text[at:]

    return read


def paragraphs(text: str) -> Iterator[Piece]:
    """Plain text: what stands between empty lines."""
    for part in re.split(r"(\n[ \t]*\n)", text):
        yield from _run(part, str)


# Inline elements of the formats that have any, and elements without text.
_DITA_INLINE = ("b", "i", "u", "ph", "term", "xref", "uicontrol", "codeph", "keyword", "image", "sub", "sup", "cite", "q", "tt")
#: Reader and encoder of each format.
FORMATS: dict[str, tuple[Callable[[str], Iterator[Piece]], Callable[[str], str]]] = {
    "plaintext": (paragraphs, str), "properties": (properties, to_properties), "po": (po, to_po), "srt": (srt, str), "vtt": (vtt, lambda t: _replaced(t, _XML_TEXT[:2])), "json": (json_strings, to_json), "php": (php, to_php),
    "javascript": (javascript, to_javascript), "rc": (rc, to_rc), "mif": (mif, to_mif), "html": (html_blocks, to_html), "markdown": (markdown, str), "xml": (xml_texts(), to_xml),
    "dita": (xml_texts(_DITA_INLINE, ("codeblock", "draft-comment")), to_html), "qti": (xml_texts(("b", "i", "em", "strong", "sub", "sup", "span"), ("math",)), to_html), "inx": (elements("pcnt"), to_xml), "icml": (elements("Content"), to_xml),
    "resx": (resx, to_xml), "ts": (bilingual("message", target="translation", approved=lambda u, t: 'type="unfinished"' not in t), to_xml), "txml": (bilingual("segment", key="segmentId"), to_xml),
    "txlf": (bilingual("trans-unit", key="id", approved=lambda u, t: 'approved="yes"' in u), to_xml), "wpml": (bilingual("trans-unit", key="resname"), to_xml),
    "xliff1": (bilingual("trans-unit", key="id", approved=lambda u, t: 'approved="yes"' in u), to_xml), "xliff2": (bilingual("segment", key="id", approved=lambda u, t: 'state="final"' in u), to_xml),
    "sdlxliff": (bilingual("trans-unit", source="seg-source", key="id"), to_xml),
}


def pieces(fmt: str, text: str | None) -> list[Piece]:
    return [] if text is None else [p for p in FORMATS[fmt][0](text) if p != ""]


def slots(fmt: str, text: str | None) -> list[Slot]:
    return [p for p in pieces(fmt, text) if isinstance(p, Slot)]


def write(fmt: str, text: str | None, translations: list[str | None]) -> str | None:
    """The document with the translations of its slots in order; one that is null or missing leaves its slot as it is."""
    if text is None:
        return None
    encode, out, n = FORMATS[fmt][1], [], 0
    for p in pieces(fmt, text):
        if isinstance(p, Slot):
            new = translations[n] if n < len(translations) else None
            out.append(p.raw if new is None else encode(new))
            n += 1
        else:
            out.append(p)
    return "".join(out)


def read_units(documents: DataFrame, fmt: str, key: str, text: str) -> DataFrame:
    """``key, ord, name, source, target, approved, note`` of the documents' slots."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(k, i, s.name, s.unit, None if s.source is None else s.text, s.approved, s.note) for k, t in zip(keys, texts) for i, s in enumerate(slots(fmt, t))]
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=[key, "ord", "name", "source", "target", "approved", "note"])

    return documents.select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, f"{key} bigint, ord int, name string, source string, target string, approved boolean, note string")


def write_documents(documents: DataFrame, fmt: str, key: str, text: str, translations: str) -> DataFrame:
    """``key, written`` of documents with the column ``translations``: a list of texts in order of the slots."""

    def run(batches):
        for batch in batches:
            out = [write(fmt, t, n or []) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "written"])

    return documents.select(F.col(key).cast("bigint"), F.col(text).cast("string"), F.col(translations)).mapInArrow(run, f"{key} bigint, written string")
