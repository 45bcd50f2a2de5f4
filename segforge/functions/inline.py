"""Inline tags within text, as Column builders; nothing leaves the JVM.

A tag is what a pattern matches. Numbering, merging, trimming and restoring work on the two lists of texts between tags and of
tags. Null gives null; a text without tags stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of tags, of conversion marks of C, of attributes and of inline Markdown.
TAG = "<[^>]+>"
C_FORMAT = "%(?:[0-9]+\\$)?[-+ #0]*[0-9]*(?:\\.[0-9]+)?[diouxXfeEgGcs]"
ATTRIBUTE = "([A-Za-z_:][A-Za-z0-9_:.\\-]*)\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)')"
MARKDOWN = "\\\\[!-/:-@\\[-`{-~]|`+[^`]*`+|!?\\[[^\\]]*\\]\\([^)]*\\)|\\[\\^[^\\]]*\\]|\\*{1,3}|~{1,2}|==|\\^|\\$\\$[^$]*\\$\\$|\\$[^$ ][^$]*\\$|<[^>]+>|:[a-z_]+:"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tags(c: Column, pattern: str = TAG) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)


def between(c: Column, pattern: str = TAG) -> Column:
    """Texts before, between and after the tags: one more than there are tags."""
    return F.split(c, pattern)


def put(texts: Column, marks: Column) -> Column:
    """Texts and marks in turn."""
    return F.array_join(F.zip_with(texts, F.concat(marks, F.array(F.lit(""))), lambda t, m: F.concat(t, m)), "")


def numbered(c: Column, pattern: str = TAG) -> Column:
    """Each tag as a placeholder with its number."""
    return put(between(c, pattern), F.transform(tags(c, pattern), lambda t, i: F.concat(F.lit('<ph id="'), i.cast("string"), F.lit('">'), escape(t), F.lit("</ph>"))))


def merged(c: Column, pattern: str = TAG) -> Column:
    """Tags in a row as one placeholder."""
    return numbered(c, f"(?:{pattern})+")


def shared_ids(c: Column, other: Column, pattern: str = TAG) -> Column:
    """Each tag as a placeholder that has the number of the first equal tag of the other text, else a new one after those."""
    mine, theirs = tags(c, pattern), tags(other, pattern)
    number = lambda t, i: F.when(F.array_position(theirs, t) > 0, F.array_position(theirs, t) - 1).otherwise(F.size(theirs) + i)
    return put(between(c, pattern), F.transform(mine, lambda t, i: F.concat(F.lit('<ph id="'), number(t, i).cast("string"), F.lit('"/>'))))


def edges(c: Column, pattern: str = TAG) -> tuple[Column, Column, Column]:
    """(tag that moves before the text, text, tag that moves after it): a single tag at an edge, or two that stand at both."""
    n, lead, trail = F.size(tags(c, pattern)), c.rlike(f"^(?:{pattern})"), c.rlike(f"(?:{pattern})\\z")
    both = (n == 2) & lead & trail
    before = F.when(both | ((n == 1) & lead), F.element_at(tags(c, pattern), 1)).otherwise("")
    after = F.when(both | ((n == 1) & trail & ~lead), F.element_at(tags(c, pattern), -1)).otherwise("")
    return before, F.substring(c, F.length(before) + 1, F.length(c) - F.length(before) - F.length(after)), after


def pure(c: Column) -> Column:
    """Text without codes: placeholders go with their content, of markers and sub-flows the text stays."""
    codes = F.regexp_replace(c, "<(?:ph|bpt|ept|it|ut)(?:\\s[^>]*)?>[^<]*</(?:ph|bpt|ept|it|ut)>|<(?:x|bx|ex)(?:\\s[^>]*)?/>", "")
    return F.regexp_replace(codes, "</?(?:mrk|sub|g)(?:\\s[^>]*)?>", "")


def protected(c: Column) -> Column:
    """Texts of protected markers."""
    return F.regexp_extract_all(c, F.lit("<mrk mtype=\"protected\">([^<]*)</mrk>"), 1)


def attributes(tag: Column) -> Column:
    """List of (name, value) of a start tag."""
    get = lambda i: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), i)
    return F.zip_with(get(1), F.zip_with(get(2), get(3), lambda a, b: F.concat(a, b)), lambda n, v: F.struct(n.alias("name"), v.alias("value")))


def without_changes(c: Column) -> Column:
    """Tracked changes accepted: what was deleted goes, what was inserted stays."""
    return F.regexp_replace(F.regexp_replace(c, "<del>[^<]*</del>", ""), "</?ins>", "")


def without_comments(c: Column) -> Column:
    """Comment markers removed, their text stays."""
    return F.regexp_replace(c, "<mrk type=\"comment\"[^>]*>([^<]*)</mrk>", "$1")


def to_2x(c: Column) -> Column:
    """Inline codes of 1.2 as those of 2.x."""
    out = F.regexp_replace(F.regexp_replace(c, "<g id=\"([^\"]*)\">", "<pc id=\"$1\">"), "</g>", "</pc>")
    return F.regexp_replace(out, "<x id=\"([^\"]*)\"/>", "<ph id=\"$1\"/>")


def to_12(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(c, "<pc id=\"([^\"]*)\">", "<g id=\"$1\">"), "</pc>", "</g>")
    return F.regexp_replace(out, "<ph id=\"([^\"]*)\"/>", "<x id=\"$1\"/>")


def to_tmx(c: Column) -> Column:
    """Inline codes as those of a memory: pairs as bpt and ept, single ones as ph."""
    out = F.regexp_replace(c, "<g id=\"([^\"]*)\">", "<bpt type=\"xliff-g\" i=\"$1\">&lt;g id=\"$1\"&gt;</bpt>")
    return F.regexp_replace(F.regexp_replace(out, "</g>", "<ept>&lt;/g&gt;</ept>"), "<x id=\"([^\"]*)\"/>", "<ph type=\"xliff-x\" x=\"$1\"/>")
