"""Character trigram models of languages in tables of fixed size.

Trigrams are hashed into ``BUCKETS`` cells for each language, so what a model sends to the driver and back to the
executors is bounded by languages times buckets, whatever the corpus. Counting and scoring run over all texts of a batch
at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16
BUCKETS = 1 << BITS
#: Languages of the project, the order of the model's rows.
LANGUAGES = ["en", "de", "fr", "es", "pt", "pl", "ru", "ja", "zh", "th", "ar", "hi"]
ROW = {name: i for i, name in enumerate(LANGUAGES)}
_A, _B, _C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(64 - BITS)
_MASK = (1 << 64) - 1
_D_WORD = np.uint64(0x9E3779B97F4A7C15)
_D_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def primary(tag: Column) -> Column:
    """Primary subtag in small letters: en for EN, en_US and en-GB; null stays null."""
    return F.lower(F.regexp_extract(tag, "^[A-Za-z]+", 0))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, each followed by a line end; start of each text and the end of the last)."""
    small = [t.lower().replace("\n", " ") for t in texts]
    codes = np.frombuffer(("\n".join(small) + "\n").encode("utf-32-le", "replace"), np.uint32) if small else np.zeros(0, np.uint32)
    starts = np.zeros(len(small) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in small], out=starts[1:])
    return codes, starts


def trigrams(codes: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each place; -1 where it spans two texts. Digits are one character."""
    c = codes.astype(np.uint64)
    c[(c >= 48) & (c <= 57)] = 48
    out = np.full(len(c), -1, np.int64)
    if len(c) > 2:
        mixed = ((c[:-2] * _A) ^ (c[1:-1] * _B + np.uint64(1))) * _C + c[2:] * _A
        mixed ^= mixed >> np.uint64(29)
        out[:-2] = ((mixed * _B) >> _D).astype(np.int64)
        ends = codes == 10
        out[:-2][ends[:-2] | ends[1:-1]] = -1
    return out


def trigram_of(text: str) -> int:
    """Bucket of the last three characters of a text in small letters, as ``trigrams`` has it."""
    a, b, c = (48 if "0" <= x <= "9" else 32 if x == "\n" else ord(x) for x in text[-3:])
    mixed = (((a * int(_A)) ^ (b * int(_B) + 1)) * int(_C) + c * int(_A)) & _MASK
    mixed ^= mixed >> 29
    return ((mixed * int(_B)) & _MASK) >> (64 - BITS)


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, start) of each run of characters other than white space, from prefix sums of powers."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = (codes == 32) | (codes == 10) | (codes == 9) | (codes == 0xA0) | (codes == 0x3000)
    begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(codes), _D_WORD, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * powers)])
        inverse = np.cumprod(np.full(len(codes), _D_INVERSE, np.uint64))
        h = (sums[end] - sums[begin]) * inverse[begin]
        h ^= h >> np.uint64(31)
        return ((h * _B) >> _D).astype(np.int64), begin


def counts(texts: DataFrame, keep=None, with_words: bool = False) -> DataFrame:
    """``row, bucket, n`` of ``lang, text``; every task sends its sums, not its trigrams. ``keep(lang, text)`` chooses
    the texts to learn from. With words, rows from the number of languages on hold word counts."""

    def run(batches):
        table = np.zeros(((1 + with_words) * len(LANGUAGES), BUCKETS), np.int64)
        for batch in batches:
            langs, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            chosen = [i for i, (a, b) in enumerate(zip(langs, values)) if a in ROW and b and (keep is None or keep(a, b))]
            codes, starts = codes_of([values[i] for i in chosen])
            row = np.repeat(np.array([ROW[langs[i]] for i in chosen], np.int64), np.diff(starts))
            grams = trigrams(codes)
            good = grams >= 0
            table.reshape(-1)[: len(LANGUAGES) * BUCKETS] += np.bincount(row[good] * BUCKETS + grams[good], minlength=len(LANGUAGES) * BUCKETS)
            if with_words:
                found, at = words(codes)
                table.reshape(-1)[len(LANGUAGES) * BUCKETS :] += np.bincount(row[at] * BUCKETS + found, minlength=len(LANGUAGES) * BUCKETS)
        rows, buckets = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(buckets.astype(np.int32)), pa.array(table[rows, buckets])], names=["row", "bucket", "n"])

    return texts.select("lang", "text").mapInArrow(run, "row int, bucket int, n bigint").groupBy("row", "bucket").agg(F.sum("n").alias("n"))


def table_of(counted: DataFrame, with_words: bool = False) -> np.ndarray:
    """The counts as an array; at most languages times buckets cells (twice that with words) reach the driver."""
    out = np.zeros(((1 + with_words) * len(LANGUAGES), BUCKETS), np.int64)
    got = counted.toArrow()
    if got.num_rows:
        out[got["row"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def log_probabilities(table: np.ndarray, floor: float = 0.05) -> np.ndarray:
    total = table.sum(axis=1, keepdims=True) + floor * BUCKETS
    return np.log((table + floor) / total).astype(np.float32)


def scores(texts: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log probabilities of each text under each language, number of its trigrams)."""
    codes, starts = codes_of(texts)
    if not len(texts):
        return np.zeros((0, len(LANGUAGES)), np.float32), np.zeros(0, np.int64)
    grams = trigrams(codes)
    good = grams >= 0
    per = np.where(good[:, None], model.T[np.maximum(grams, 0)], 0)
    return np.add.reduceat(per, starts[:-1], axis=0), np.add.reduceat(good.astype(np.int64), starts[:-1])
