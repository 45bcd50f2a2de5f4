"""Structured formats to segments: ``read_segments(df, format)`` parses one document a row inside ``mapInArrow``.

Every reader gives ordered units: id, name, source, target, approved, note. Text that isn't translatable is no unit.
Defined results: null and empty content gives no units; content that doesn't parse gives none and one row whose
``error`` says why. Inline tags stay in the text. Formats that are also written are read as pieces (``formats``); packages are in ``packages``.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.sources import formats

TAG = re.compile(r"</?[A-Za-z][^>]*>")
Unit = tuple  # (id, name, source, target, approved, note)


def unit(i, source, name=None, target=None, approved=None, note=None) -> Unit:
    return (str(i), name, source, target, approved, note)



def plain_lines(text: str) -> Iterator[Unit]:
    for n, line in enumerate(x for x in text.splitlines() if x.strip()):
        yield unit(n, line)







def json_strings(text: str) -> Iterator[Unit]:
    """All string leaves with their path as name."""
    def walk(value, path):
        if isinstance(value, str):
            if value.strip():
                yield path, value
        elif isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, f"{path}.{k}" if path else str(k))
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from walk(v, f"{path}[{i}]")

    docs = [json.loads(text)] if not _json_lines(text) else [json.loads(x) for x in text.splitlines() if x.strip()]
    n = 0
    for doc in docs:
        for path, value in walk(doc, ""):
            yield unit(n, value, path)
            n += 1


def _json_lines(text: str) -> bool:
    try:
        json.loads(text)
        return False
    except ValueError:
        return True


def json_configured(text: str, config: dict) -> Iterator[Unit]:
    """Objects with configured source, target, id, name, note and approved keys; ignored keys are skipped."""
    ignored = set(config.get("ignorable", []))

    def walk(value):
        if isinstance(value, dict):
            used = set()
            for c in config["translatable"]:
                if isinstance(value.get(c["sourceKey"]), str):
                    used |= {v for v in c.values() if isinstance(v, str)}
                    get = lambda k: value.get(c.get(k)) if c.get(k) else None  # noqa: B023, E731
                    yield get("idKey"), value[c["sourceKey"]], get("resnameKey"), get("targetKey"), get("approvedKey"), get("noteKey")
            for k, v in value.items():
                if k not in used and k not in ignored:
                    yield from walk(v)
        elif isinstance(value, list):
            for v in value:
                yield from walk(v)

    seen = set()
    for n, (i, source, name, target, approved, note) in enumerate(walk(json.loads(text))):
        if i is not None and str(i) in seen:
            raise ValueError(f"duplicate id {i}")
        seen.add(str(i))
        yield unit(n if i is None else i, source, name, target, None if approved is None else str(approved).lower() in ("true", "yes", "1"), note if note is None else str(note))


# Elements that part text, elements without text and attributes with text.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main meta nav ol option p pre section select summary table tbody td tfoot thead tr ul".split())
SILENT = {"script", "style"}
SPOKEN = ("alt", "content", "label", "placeholder", "title")


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.units: list[str] = []
        self.held, self.silent, self.pre = [], 0, 0

    def flush(self):
        body = "".join(self.held)
        if not self.pre:
            body = re.sub(r"[ \n\t\r\f]+", " ", body).strip()
        if TAG.sub("", body).strip():
            self.units.append(body)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
            return
        spoken = [v for k, v in attrs if k in SPOKEN and v and v.strip() and not (tag == "meta" and not any(a == "name" and b in ("description", "keywords", "author") for a, b in attrs))]
        if tag in BLOCKS:
            self.flush()
        else:
            self.held.append(self.get_starttag_text() or f"<{tag}>")
        self.units += spoken
        self.pre += tag == "pre"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT:
            self.silent -= 1

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS:
            self.flush()
            self.pre = max(0, self.pre - (tag == "pre"))
        else:
            self.held.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.silent:
            self.held.append(data)


def html_units(text: str) -> Iterator[Unit]:
    parser = _Html()
    parser.feed(text)
    parser.close()
    parser.flush()
    for n, body in enumerate(parser.units):
        yield unit(n, body)



def _local(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _inner(e) -> str:
    """Text of an element with its inline elements as markup."""
    if e is None:
        return ""
    parts = [html.escape(e.text or "", quote=False) if len(e) else e.text or ""]
    for c in e:
        parts.append(re.sub(r"\s?xmlns(:\w+)?=\"[^\"]*\"", "", ET.tostring(c, encoding="unicode").replace("ns0:", "")))
    return "".join(parts)


def xml_units(text: str, segment: set[str] | None = None, ignore: set[str] = frozenset()) -> Iterator[Unit]:
    """Elements with direct text, or the configured ones."""
    n = 0

    def walk(e):
        nonlocal n
        name = _local(e)
        if name in ignore:
            return
        direct = (e.text or "").strip() or any((c.tail or "").strip() for c in e)
        if (segment is None and direct) or (segment is not None and name in segment):
            if "".join(e.itertext()).strip():
                n += 1
                yield unit(n - 1, _inner(e), name)
            return
        for c in e:
            yield from walk(c)

    yield from walk(ET.fromstring(text))


def xliff(text: str) -> Iterator[Unit]:
    """Units of exchange files 1.x and segments of 2.x, with inherited translate."""
    def walk(e, translate):
        name = _local(e)
        translate = e.get("translate", translate)
        kids = {_local(c): c for c in reversed(list(e))}
        if name == "trans-unit":
            if translate != "no" and "".join(kids["source"].itertext()).strip():
                notes = [c.text for c in e if _local(c) == "note" and c.text]
                yield unit(e.get("id", ""), _inner(kids["source"]), e.get("resname"), _inner(kids["target"]) if "target" in kids else None, e.get("approved") == "yes", "\n".join(notes) or None)
        elif name == "unit":
            notes = [c.text for c in e.iter() if _local(c) == "note" and c.text]
            if translate != "no":
                for k, s in enumerate(c for c in e if _local(c) == "segment"):
                    parts = {_local(c): c for c in s}
                    if "source" in parts and "".join(parts["source"].itertext()).strip():
                        yield unit(f"{e.get('id', '')}-{s.get('id', k)}", _inner(parts["source"]), e.get("name"), _inner(parts["target"]) if "target" in parts else None, s.get("state") == "final", "\n".join(notes) or None)
        else:
            for c in e:
                yield from walk(c, translate)

    yield from walk(ET.fromstring(text), "yes")




def tmx(text: str) -> Iterator[Unit]:
    """Memory units: the first variant is the source, the second the target."""
    for n, tu in enumerate(ET.fromstring(text).iter("tu")):
        segs = [_inner(v.find("seg")) for v in tu.iter("tuv")]
        if segs:
            yield unit(tu.get("tuid", n), segs[0], target=segs[1] if len(segs) > 1 else None, approved=len(segs) > 1)


def csv_units(text: str) -> Iterator[Unit]:
    for n, row in enumerate(csv.reader(io.StringIO(text))):
        for c, cell in enumerate(row):
            if cell.strip() and not re.fullmatch(r"[\s\d.,%$€£+-]+", cell):
                yield unit(f"{n}.{c}", cell)


def office(data: bytes) -> Iterator[Unit]:
    """Paragraphs of an office package's XML members; masters, layouts and numeric cells are skipped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [x for x in z.namelist() if x.endswith(".xml") and not re.search(r"(?i)master|layout|theme|styles|settings|fontTable|docProps|\[Content", x)]
        for name in sorted(names, key=lambda x: re.sub(r"\d+", lambda m: m.group().zfill(8), x)):
            root = ET.fromstring(z.read(name))  # a broken member makes the package one row with an error
            for k, p in enumerate(e for e in root.iter() if _local(e) in ("p", "si", "h")):
                body = "".join(e.text or "" for e in p.iter() if _local(e) in ("t", "p", "h", "span", "a"))
                if body.strip() and not re.fullmatch(r"[\s\d.,%$€£+-]+", body):
                    yield unit(f"{name}:{k}", body)


def by_pieces(fmt: str):
    """Reader of a format that is read and written as pieces."""
    return lambda text: (unit(i, s.unit, s.name, None if s.source is None else s.text, s.approved, s.note) for i, s in enumerate(formats.slots(fmt, text)))


READERS = {fmt: by_pieces(fmt) for fmt in formats.FORMATS} | {"plainlines": plain_lines, "json": json_strings, "html": html_units, "xml": xml_units, "xliff": xliff, "tmx": tmx, "csv": csv_units}
SCHEMA = "unit_ord int, unit_id string, name string, source string, target string, approved boolean, note string, error string"


def parse(fmt: str, content, **options) -> tuple[list[Unit], str | None]:
    """Units of one document, or the reason why there are none."""
    if content is None or not len(content):
        return [], None
    try:
        if fmt == "office":
            return list(office(content)), None
        if fmt == "json" and options.get("config"):
            return list(json_configured(content, options["config"])), None
        return list(READERS[fmt](content, **options)), None
    except (ValueError, ET.ParseError, zipfile.BadZipFile, AttributeError, KeyError) as reason:
        return [], f"{type(reason).__name__}: {reason}"


def read_segments(df: DataFrame, fmt: str, key: str = "doc_id", content: str = "text", **options) -> DataFrame:
    """Units of all documents; a document that can't be read is one row with an error."""
    if fmt != "office" and fmt not in READERS:
        raise ValueError(f"unknown format {fmt}")
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units, error = parse(fmt, c, **options)
                rows += [(k, i, *u, None) for i, u in enumerate(units)]
                if error:
                    rows.append((k, None, None, None, None, None, None, None, error))
            kinds = [batch.schema.field(0).type, pa.int32(), *[pa.string()] * 4, pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[key, *[c.split()[0] for c in SCHEMA.split(", ")]])

    return df.select(key, F.col(content)).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
