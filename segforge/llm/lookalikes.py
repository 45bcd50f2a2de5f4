"""One form for text that looks the same.

``canonical_form`` brings text to one form for comparison: compatibility composition, full case folding, mapped white
space, no default-ignorable characters, look-alike letters replaced by their Latin twins. ``look`` is the stricter key of what the eye
can't tell apart: width variants, kinds of space, invisible characters, combining or composed accents and look-alike
letters count as the same; case, digits, accents, punctuation and the number of spaces don't.

Both are applied once to each distinct value. Values are grouped before anything is computed, so a text that a third of
all rows share is one value.

Defined results: null and blank texts have no form and never count. Ties go to the smaller key. Re-sent units count
once. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.io import materialise

# Letters of other scripts and the Latin letters that they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝҮүӀ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaeopcyxsijhdqwYyl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονραικυ"
GREEK_AS = "ABEZHIKMNOPTYXovpaiku"
ARMENIAN = "ՕՍոսհցօ"
ARMENIAN_AS = "OUnuhgo"
CHEROKEE = "ᎪᏟᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ"
CHEROKEE_AS = "ACEHJKLMPSTVWZ"
OTHER = "ɑɡıℓꓐꓚꓓꓰꓖꓧꓗꓡꓟꓠꓳꓑꓢꓔꓴꓦꓪꓫꓬꓜ"
OTHER_AS = "agilBCDEGHKLMNOPSTUVWXYZ"
LATIN_TWIN = {ord(a): b for x, y in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS), (OTHER, OTHER_AS)) for a, b in zip(x, y, strict=True)}
#: Default-ignorable characters.
IGNORABLE = re.compile("[\xad\u034f\u061cᅟᅠ\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206fㅤ\ufe00-\ufe0f\ufeffﾠ\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
#: Decompositions that keep the look: width variants, presentation ligatures and Thai and Lao AM.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
LIGATURES = range(0xFB00, 0xFB07)


class _Look(dict):
    """Translation table of single characters on decomposed text, filled on demand."""

    def __missing__(self, code: int):
        c = chr(code)
        out: str | int | None = code
        if unicodedata.category(c) == "Zs":
            out = " "
        elif IGNORABLE.match(c):
            out = None
        elif code in LATIN_TWIN:
            out = LATIN_TWIN[code]
        elif code in LIGATURES or code in (0xE33, 0xEB3) or unicodedata.decomposition(c).split(" ")[0] in SAME_LOOK:
            out = "".join(x if (y := self[ord(x)]) == ord(x) else y if isinstance(y, str) else "" for x in unicodedata.normalize("NFKC", c))
        self[code] = out
        return out


_LOOK = _Look()
_AFTER = {code: twin for code, twin in LATIN_TWIN.items()}


def look(text: str | None) -> str | None:
    """Key of what the text looks like; None for null and blank text."""
    if text is None or not text.strip():
        return None
    if text.isascii():
        return text
    key = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_LOOK))
    return key if key.strip() else None


def canonical_form(text: str | None) -> str | None:
    """The one form for comparisons that also ignore case and runs of white space."""
    if text is None:
        return None
    bare = IGNORABLE.sub("", unicodedata.normalize("NFKC", text))
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFD", bare).translate(_AFTER).casefold())
    return " ".join(folded.translate(_AFTER).split())


def _values(texts: DataFrame, schema: str, function) -> DataFrame:
    def run(batches):
        for batch in batches:
            made = [function(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "form"])

    return texts.mapInArrow(run, schema)


def canonical(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, text, form`` of every distinct value of the given columns."""
    values = _long(df, None, fields).groupBy("field", "text").agg(F.count("*").alias("n"))
    return _values(values.select("field", "n", "text"), "field string, n bigint, text string, form string", canonical_form)


def _long(df: DataFrame, key: str | None, fields: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("p")
    out = df.select(*([F.col(key).cast("bigint").alias("unit_key")] if key else []), pairs).select(*(["unit_key"] if key else []), "p.field", "p.text")
    return out.where("text is not null and trim(text) <> ''")


def _digests(text: str) -> list:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7919), F.col(text), F.length(text)).alias("t2")]


def found(df: DataFrame, key: str = "unit_key", fields: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """Pairs of units of which a field looks the same but is not the same string.

    Different strings of one look are all paired. Of a string's exact copies each one is paired with the first copy of
    every other string of that look and the other way round, so rows grow with the units, not with their square, and no
    link between different texts is lost; small groups come out in full.
    """
    every = _long(df, key, list(fields))
    values = every.groupBy("field", "text").agg(F.min("unit_key").alias("first"))
    formed = _values(values.select("field", "first", "text"), "field string, first bigint, text string, form string", look).where("form is not null")
    slim = formed.select("field", "first", *_digests("text"), F.xxhash64("form").alias("f1"), F.xxhash64(F.lit(7919), F.col("form"), F.length("form")).alias("f2"))
    slim = materialise(slim)
    several = slim.groupBy("field", "f1", "f2").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi"), F.min("t2").alias("lo2"), F.max("t2").alias("hi2"))
    several = several.where("lo <> hi or lo2 <> hi2").select("field", "f1", "f2")
    shared = slim.join(several, ["field", "f1", "f2"], "left_semi")
    a, b = shared.alias("a"), shared.alias("b")
    links = a.join(b, ["field", "f1", "f2"]).where("a.t1 <> b.t1 or a.t2 <> b.t2").select("field", F.col("a.t1").alias("t1"), F.col("a.t2").alias("t2"), F.col("b.first").alias("other"))
    members = every.select("unit_key", "field", *_digests("text"))
    pairs = members.join(links, ["field", "t1", "t2"])
    return pairs.select(F.least("unit_key", "other").alias("unit_key_a"), F.greatest("unit_key", "other").alias("unit_key_b"), "field").distinct()
