"""Packages (archives of marked-up members): their texts in order, and the package with translations.

A kind says which members hold text, in what order they come and how each is read. Members that hold none are copied as they
are; a package written without translations has the same members with the same bytes.

Defined results: null gives nothing. What is no archive raises ``zipfile.BadZipFile``. Members named by a manifest come in its order,
others by name with numbers padded.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

from segforge.sources import formats
from segforge.sources.formats import Piece, Slot

_ODF_INLINE = ("text:span", "text:a", "text:s", "text:tab", "text:line-break", "text:bookmark")
#: Pattern of the members with text, reader of a member, encoder of a text, and pattern of member names within the manifest (its name first).
KINDS: dict[str, tuple[str, Callable[[str], Iterator[Piece]], Callable[[str], str], tuple[str, str] | None]] = {
    "docx": (r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", formats.elements("w:t"), formats.to_xml, None),
    "xlsx": (r"xl/(?:sharedStrings|comments\d*)\.xml", formats.elements("t"), formats.to_xml, None),
    "pptx": (r"ppt/(?:slides/slide|notesSlides/notesSlide)\d+\.xml", formats.elements("a:t"), formats.to_xml, None),
    "odf": (r"(?:content|styles)\.xml", formats.xml_texts(_ODF_INLINE, ("office:meta", "office:styles")), formats.to_html, None),
    "idml": (r"Stories/Story_[^/]+\.xml", formats.elements("Content"), formats.to_xml, ("designmap.xml", r'src="(Stories/[^"]+)"')),
    "qti": (r"(?!imsmanifest)[^/]+\.xml", formats.FORMATS["qti"][0], formats.to_html, ("imsmanifest.xml", r'<resource[^>]*\shref="([^"]+)"')),
    "sdlppx": (r"[A-Za-z\-]+/[^/]+\.sdlxliff", formats.FORMATS["sdlxliff"][0], formats.to_xml, None),
}


def _padded(name: str) -> str:
    return re.sub(r"\d+", lambda m: m.group().zfill(10), name)


def members(kind: str, z: zipfile.ZipFile) -> list[str]:
    """Members with text, in order."""
    pattern, _, _, manifest = KINDS[kind]
    names = sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=_padded)
    if manifest and manifest[0] in z.namelist():
        order = {n: i for i, n in enumerate(re.findall(manifest[1], z.read(manifest[0]).decode("utf-8")))}
        names.sort(key=lambda n: order.get(n, len(order)))
    return names


def slots(kind: str, data: bytes | None) -> list[tuple[str, Slot]]:
    """(member, slot) of a package."""
    if data is None:
        return []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(n, p) for n in members(kind, z) for p in KINDS[kind][1](z.read(n).decode("utf-8")) if isinstance(p, Slot)]


def write(kind: str, data: bytes | None, translations: list[str | None]) -> bytes | None:
    """The package with the translations of its slots in order; missing ones leave their slots as they are."""
    if data is None:
        return None
    _, read, encode, _ = KINDS[kind]
    out, n = io.BytesIO(), 0
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        made: dict[str, str] = {}
        for name in members(kind, z):
            parts = []
            for p in read(z.read(name).decode("utf-8")):
                if isinstance(p, Slot):
                    t = translations[n] if n < len(translations) else None
                    parts.append(p.raw if t is None else encode(t))
                    n += 1
                else:
                    parts.append(p)
            made[name] = "".join(parts)
        for info in z.infolist():
            new.writestr(info, made[info.filename].encode("utf-8") if info.filename in made else z.read(info))
    return out.getvalue()
