"""Records that are copies but for white space, letter case, punctuation, field order and notation.

Columns are dictionary-encoded batch by batch: every distinct value is canonicalised once and gets a 128-bit integer
made from its words, a record becomes its sorted (field, value) integers, and the compact tuples are grouped. Each task
needs only its own dictionary because the integer follows from the words alone. The tuple is kept as two independent
64-bit digests of the sorted integers, each value integer being 128 bits before that, so records can be grouped across billions.

Canonical words: composed form, full case folding, letters, marks and digits only. Punctuation and white space part
words, but not between or beside letters of scripts that put no spaces between words, where they vanish.

Defined results: a null or blank record is no copy of anything. A record that doesn't parse is compared by its raw
words. A field that is absent, null or without words is the same as none. Values that are no strings are compared by
their JSON text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.io import materialise, skew_join

#: Blocks of scripts written without spaces (Thai to Khmer, kana, ideographs, half-width kana).
UNSPACED = "\u0e00-\u0effက-႟ក-\u17ff⺀-\u2fdf々-〇\u3040-ヿㇰ-ㇿ㐀-鿿豈-\ufaffｦ-ﾟ\U00020000-\U0003ffff"
_BESIDE = re.compile(f" (?=[{UNSPACED}])|(?<=[{UNSPACED}]) ")
#: Values remembered by a task; memory only.
DICTIONARY = 100_000


class _Letters(dict):
    """Translation table filled on demand: letters, marks and digits stay, format characters go, the rest parts words."""

    def __missing__(self, code: int):
        kind = unicodedata.category(chr(code))
        self[code] = out = code if kind[0] in "LNM" else None if kind == "Cf" else " "
        return out


_LETTERS = _Letters()


def words_of(value: str) -> str:
    """Canonical words of a value, parted by single spaces."""
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", value).casefold())
    return _BESIDE.sub("", " ".join(folded.translate(_LETTERS).split()))


def fields_of(record: str) -> dict[str, str] | None:
    """Fields of a JSON object or of one element's attributes; None if it is neither."""
    body = record.strip()
    try:
        if body.startswith("<"):
            element = ET.fromstring(body)
            found = dict(element.attrib)
            for child in element:
                found.setdefault(child.tag, "".join(child.itertext()))
            return found
        value = json.loads(body)
    except (ValueError, ET.ParseError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    return {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False) for k, v in value.items() if v is not None}


def identifier(name: str, words: str) -> bytes:
    return hashlib.blake2b(f"{name}\0{words}".encode("utf-8", "replace"), digest_size=16).digest()


class Dictionary:
    """Identifiers of the distinct values that a task has met."""

    def __init__(self):
        self.known: dict[tuple[str, str], bytes] = {}

    def of(self, name: str, value: str) -> bytes:
        at = (name, value)
        got = self.known.get(at)
        if got is None:
            if len(self.known) >= DICTIONARY:
                self.known.clear()
            words = words_of(value)
            got = self.known[at] = identifier(name, words) if words else b""
        return got

    def record(self, record: str | None) -> tuple[int, int] | None:
        """The record's compact tuple of sorted identifiers, as two 64-bit integers."""
        if record is None or not record.strip():
            return None
        fields = fields_of(record)
        named = fields.items() if fields is not None else [("\0raw", record)]
        ids = sorted(i for name, value in named if (i := self.of(name, value)))
        return struct.unpack("<qq", hashlib.blake2b(b"".join(ids), digest_size=16).digest()) if ids else None


def keyed(df: DataFrame, key: str = "record_id", record: str = "record") -> DataFrame:
    """Each record's id with its compact tuple ``k1, k2`` (null for records without words)."""

    def run(batches):
        dictionary = Dictionary()
        for batch in batches:
            tuples = [dictionary.record(r) for r in batch.column(1).to_pylist()]
            columns = [pa.array([t and t[i] for t in tuples], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["record_id", "k1", "k2"])

    return df.select(F.col(key).cast("bigint"), F.col(record).cast("string")).mapInArrow(run, "record_id bigint, k1 bigint, k2 bigint")


def collapse(df: DataFrame, key: str = "record_id", record: str = "record") -> DataFrame:
    """One row for each set of copies: smallest id and number of copies. Counted before the shuffle, so a set that
    holds a third of all rows costs one partial row a task."""
    k = materialise(keyed(df, key, record))
    sets = k.where("k1 is not null").groupBy("k1", "k2").agg(F.min("record_id").alias("keep_id"), F.count("*").alias("n_copies")).select("keep_id", "n_copies")
    return sets.unionByName(k.where("k1 is null").select(F.col("record_id").alias("keep_id"), F.lit(1).cast("bigint").alias("n_copies")))


def found(df: DataFrame, key: str = "record_id", record: str = "record") -> DataFrame:
    """``keep_id, dup_id``: each set's smallest id with every other. Linear in the rows, whatever the sets' sizes."""
    k = materialise(keyed(df, key, record).where("k1 is not null"))
    firsts = k.groupBy("k1", "k2").agg(F.min("record_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return skew_join(k, firsts, ["k1", "k2"], F.col("record_id")).where("record_id <> keep_id").select("keep_id", F.col("record_id").alias("dup_id"))
