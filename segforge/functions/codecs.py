"""Codecs and checks of names, dates, paths and encodings, as Column builders. Null gives null unless said otherwise."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from segforge.functions import inline

# Code pages of resource scripts and the charsets that they are.
CODE_PAGES = {
    "437": "IBM437", "737": "IBM737", "775": "IBM775", "850": "IBM850", "852": "IBM852", "855": "IBM855", "857": "IBM857", "858": "IBM00858", "862": "IBM862", "866": "IBM866", "874": "TIS-620", "932": "Shift_JIS", "936": "GBK", "949": "x-windows-949",
    "950": "Big5", "1200": "UTF-16LE", "1201": "UTF-16BE", "1250": "windows-1250", "1251": "windows-1251", "1252": "windows-1252", "1253": "windows-1253", "1254": "windows-1254", "1255": "windows-1255", "1256": "windows-1256", "1257": "windows-1257",
    "1258": "windows-1258", "20866": "KOI8-R", "28591": "ISO-8859-1", "28592": "ISO-8859-2", "28595": "ISO-8859-5", "28596": "ISO-8859-6", "28605": "ISO-8859-15", "51932": "EUC-JP", "54936": "GB18030", "65001": "UTF-8",
}
# Short names of formats.
FORMAT_NAMES = {
    "javascript": "JS", "x-dita": "DITA", "html": "HTML", "json": "JSON", "mif": "MIF", "x-office": "OFF", "plaintext": "TEXT", "x-phparray": "PHPA", "po": "PO", "javapropertyresourcebundle": "JAVA", "winres": "RC", "resx": "RESX", "x-srt": "SRT", "x-ts": "TS",
    "x-txml": "TTXML", "x-vtt": "VTT", "xml": "XML", "x-markdown": "MD", "x-idml": "IDML", "x-sdlxliff": "SDLXLIFF",
}
# Byte-order marks in hexadecimal.
MARKS = {"EFBBBF": "UTF-8", "FEFF": "UTF-16BE", "FFFE": "UTF-16LE"}
# Marks that stand for markup characters in exported memories; the ampersand isn't restored.
RESTORED = {"\u2039": "<", "\u200b\u203a": ">", "\u203a": ">", "\u201f": "\""}
# Emoji and their short codes.
SHORTCODES = {":check:": "✔", ":x:": "✗", ":star:": "★", ":warning:": "⚠", ":smile:": "😀"}
_HIGH, _LOW, _UPPER, _MIRROR = "89ABCDEF", "0123456789ABCDEF", "FEDCBA98", "FEDCBA9876543210"


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table; null for anything else."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def replaced(c: Column, table: dict[str, str]) -> Column:
    for a, b in table.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def bytes_hex(c: Column) -> Column:
    """Bytes of a text as hexadecimal; a byte from 128 on is written as 383 less its value."""
    return _mirrored(F.hex(F.encode(c, "UTF-8")))


def from_bytes_hex(c: Column) -> Column:
    return F.decode(F.unhex(_mirrored(c)), "UTF-8")


def _mirrored(c: Column) -> Column:
    pairs = F.regexp_extract_all(c, F.lit("(..)"), 1)
    return F.array_join(F.transform(pairs, lambda p: F.when(p >= "80", F.concat(F.translate(F.substring(p, 1, 1), _HIGH, _UPPER), F.translate(F.substring(p, 2, 1), _LOW, _MIRROR))).otherwise(p)), "")


def bom(data: Column) -> Column:
    """Charset of the byte-order mark; null without one."""
    head = F.hex(F.substring(data, 1, 3))
    return F.coalesce(*[F.when(head.startswith(k), F.lit(v)) for k, v in MARKS.items()])


def tmx_date(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")


def is_name(c: Column) -> Column:
    """A name of markup: starts with a letter, underscore or colon."""
    return c.rlike("^[A-Za-z_:][A-Za-z0-9_:.\\-]*$")


def is_absolute(c: Column) -> Column:
    return c.rlike("^(?:/|[A-Za-z]:[\\\\/]|[a-z]+://)")


def percent_decoded(c: Column) -> Column:
    """ASCII percent escapes; bad ones stay."""
    return replaced(c, {"%20": " ", "%28": "(", "%29": ")", "%5F": "_", "%2F": "/", "%25": "%"})


def canonical_path(c: Column) -> Column:
    """A path without ``.`` and with each ``name/..`` taken out, however many there are; leading ``..`` stay."""
    parts = F.filter(F.split(c, "/"), lambda p: (p != ".") & (p != ""))
    lead = F.when(c.startswith("/"), "/").otherwise("")
    walk = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(p))),
    )
    return F.concat(lead, F.array_join(walk, "/"))


def relative_path(base: Column, path: Column) -> Column:
    """``path`` seen from the folder ``base``: up for what they don't share, then down."""
    a, b = F.split(base, "/"), F.split(path, "/")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.coalesce(F.array_position(same, False), F.lit(0))
    shared = F.when(n == 0, F.least(F.size(a), F.size(b))).otherwise(n - 1).cast("int")
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - shared), F.slice(b, shared + 1, F.size(b) - shared + 1)), "/")


def plural_forms(c: Column) -> Column:
    """Number of plural forms that a header names, 0 without one."""
    return F.coalesce(F.regexp_extract(c, "nplurals\\s*=\\s*([0-9]+)", 1).try_cast("int"), F.lit(0))


def looking_at(c: Column, what: str, at: int) -> Column:
    """Whether a text goes on with ``what`` at a place from 0."""
    return F.substring(c, at + 1, len(what)) == what


def from_unicode_escapes(c: Column, of: dict[str, str]) -> Column:
    """``\\uXXXX`` of the given letters."""
    return replaced(c, {f"\\u{ord(v):04x}": v for v in of.values()})


#: Names of characters of markup, from the standard library.
ENTITIES = {name: chr(n) for name, n in name2codepoint.items()} | {"apos": "'"}
_REFERENCE = "&(?:#[0-9]{1,5}|#x[0-9A-Fa-f]{1,4}|[A-Za-z0-9]+);"


def from_entities(c: Column) -> Column:
    """Named, decimal and hexadecimal references (of the first 65,536 code points), each decoded once; unknown names stay."""

    def one(r: Column) -> Column:
        body = F.substring(r, 2, F.length(r) - 2)
        number = F.when(body.startswith("#x"), F.upper(F.substring(body, 3, 4))).when(body.startswith("#"), F.hex(F.substring(body, 2, 5).cast("int")))
        return F.coalesce(F.decode(F.unhex(F.lpad(number, 4, "0")), "UTF-16BE"), lookup(body, ENTITIES), r)

    return inline.put(inline.between(c, _REFERENCE), F.transform(inline.tags(c, _REFERENCE), one))
