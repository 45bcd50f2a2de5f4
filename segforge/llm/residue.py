"""Template residue, filler, error pages and script notices, learnt from trusted passages.

A record is cut into passages (lines, and sentences within lines). A few spellings that never stand in sound text mark
trusted passages of four kinds (``trusted``); all others are unlabelled. A multinomial naive Bayes is fitted by
expectation-maximisation on positive and unlabelled passages: the unlabelled ones start as sound, and each round moves
those to a kind that resemble it, until few change. The words of a passage are its evidence, and so are the length of a short record
and the passages beside it there, so page furniture and texts in languages without any trusted passage are learnt too. A record
is residue if the posterior of one of its passages says so: no row comes from a pattern. An exact check may only veto: lines of string files and
passages that quote are none, and a placeholder needs a slot.

Records are cut and masked as whole Arrow columns, and each distinct passage is judged once. The model has a fixed size
(kinds times buckets); only it reaches the driver.

Defined results: null, empty and blank texts are never residue and have no passages. Repeated texts have the same
result. Extra columns are ignored. Texts of any length are cut and scored whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.io import materialise

KINDS = ["sound", "placeholder", "error", "script_notice", "filler"]
#: Words remembered by a task; memory only.
MET = 1_000_000
#: Cells of one script, and where scripts end: Latin, Greek and Cyrillic, Hebrew and Arabic, Indic, Thai to Khmer, others.
CELLS = 1 << 16
_SCRIPT_ENDS = (0x370, 0x590, 0x900, 0xE00, 0x1800)
SCRIPTS_NUMBER = len(_SCRIPT_ENDS) + 2
#: What a cell of each script counts as: runs of characters are parts of words.
_WORTH = np.array([1, 1, 1, 1, 1, 1 / 3, 1 / 2])
BUCKETS = CELLS * SCRIPTS_NUMBER
#: Rounds at most; fewer if less than ``SETTLED`` of the weight of all kinds moves.
ROUNDS, SETTLED = 8, 0.002
#: Posterior from which a passage counts, and the least posterior with which an unlabelled passage teaches a kind.
THRESHOLD, TEACHES = 0.9, 0.85
PRIOR = np.log(np.array([0.96, 0.01, 0.01, 0.01, 0.01]))
#: Share of the words of all kinds in each kind's distribution, so that a word never seen in a kind costs a fixed factor at any size.
BACKGROUND = 0.3
#: Words of a script that a kind must have to rely on half of what they tell.
FEW = 30.0
#: Occurrences by which every count of a kind is lessened: a word that it has once or so tells nothing.
ONCE = 0.75
#: Words of a longer passage weigh as so many; they depend on each other.
WORDS_COUNT = 7.0
#: In records of so many passages at most, their number and the passages beside are evidence.
SHORT = 8
#: Share of a passage's occurrences in longer records from which its surroundings in short ones are no evidence: it's a common line.
COMMON = 0.2
#: What the surroundings can add to the log odds of a kind at most, so that a passage's own words must agree.
AROUND = 14.0

# Slots that say themselves that something must be put in their place.
TO_FILL = re.compile(r"\{\$t\([^()\n]+\)\}|<%[=\-]?[^%<>\n]+%>|\[\[[^\[\]\n]+\]\]|<<[^<>\n]+>>|<[A-Za-z][\w ]* TBD>|\[(?:INSERT|Insert|ENTER|Enter) [^\]\n]+\]|\[[^\[\]\n]+ goes here\]|«[A-Z][A-Z_]+»|@@[A-Z_]+@@|(?<![A-Za-z0-9_])(?:__[A-Z][A-Z_]+__|XXX[A-Z]*XXX|_{4,})(?![A-Za-z0-9_])")
# Other slots; format marks of string files are among them.
SLOT = re.compile(TO_FILL.pattern + r"|\{\{[^{}\n]+\}\}|[$#]\{[^{}\n]+\}|\{%[^%{}\n]+%\}|\{[A-Za-z_][\w.]*\}|\{[\d\x03]+\}|%[\d\x03]+\$[sd@]|(?<![A-Za-z0-9_%])%[sd@](?![A-Za-z0-9_])|%+[A-Z][A-Z_]+%+|%%+[\d\x03]+%%+|\$[A-Z][A-Z_]+\$|(?<![A-Za-z0-9_])TBD(?![A-Za-z0-9_])|&lt;[\w ]+&gt;")
_MAY_HOLD_SLOT = re.compile(r"[{$%\[<@«&]|__|XXX|TBD")
# Lines of string files and subtitles, numbers masked.
FORMATTED = r"^\s*(?:[{\[]?\s*\"[^\"]*\"\s*[:,]|\"[^\"]*\",?\s*[}\]]?\s*$|[\w.\-\[\]]+\s*=|msg(?:id|str|ctxt)\b|<(?:string|trans-unit|data|source|target|resource)\b|[0\x03]+\s*$|0:0[:.,0]*\s*-->|#[~,:.|]|//)"
# Status lines of error pages, and frames of a stack. \x03 stands for a number from 400 to 599.
STATUS = re.compile(r"(?i)^\W*(?:http|error|fehler|erreur|erro|błąd|ошибка|خطأ|エラー|错误|ข้อผิดพลาด|त्रुटि)\W*\x03(?!\w)|^\W*\x03 (?:not found|forbidden|bad gateway|internal server error|service unavailable)\W*$|^\s*at \w[\w.]* \([\w./]+[:.]\d+\)")
# That a service is unavailable, once a language or so.
UNAVAILABLE = regex.compile(r"(?i)^\W*(?:service (?:is )?temporarily unavailable|something went wrong on our (?:side|end)|(?:der )?dienst ist (?:\w+ )?nicht erreichbar|(?:le )?service est (?:\w+ )?indisponible|(?:el )?servicio no está disponible|serviço indisponível|usługa (?:jest )?(?:\w+ )?niedostępna|сервис временно недоступен|\w*サービスをご利用いただけません|服务(?:暂时)?不可用|บริการ(?:นี้)?ไม่พร้อมใช้งาน|الخدمة غير متاحة|सेवा (?:[\w\p{M}]+ )*उपलब्ध नहीं)")
# The plainest notices that scripts are needed, and how a language says "enable" beside the name.
SCRIPTS = re.compile(r"(?i)\b(?:enable|turn on) javascript\b|\bjavascript is (?:disabled|required)\b|\bsite requires javascript\b|\b(?:aktivieren sie|activez|activer|active|ative o|włącz obsługę|включите) javascript\b|javascript ?を有効|(?:启用|เปิดใช้งาน) ?javascript|تفعيل جافا|जावास्क्रिप्ट चालू")
# What filler is called, one term a language.
FILLER = re.compile(r"(?i)\b(?:lorem|ipsum)\b|\bplaceholder text for\b|\b(?:sample|dummy) (?:text|paragraph)\b|\bein blindtext\b|\btexte factice\b|\btexto de (?:relleno|exemplo)\b|\btekst zastępczy\b|текст-заполнитель|ダミーテキスト|占位文字|ข้อความตัวอย่าง|نص تجريبي|नमूना पाठ")
QUOTED = re.compile("[“„«「『\"‘]")
_WORD = regex.compile(r"[\p{L}\p{M}]+|\d+|[\x02-\x04]")
_ASCII_WORD = re.compile(r"[a-z]+|\d+|[\x02-\x04]")
_UNSPACED = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]{2,}")
# Patterns of the linear engine that works on whole Arrow columns.
_FILE_NAME = r"/?[\w\-]+\.(?:[a-z]{1,4}|properties)\b"
_SENTENCE_END = r"([.!?][\"”“»’)]*)[^\S\n]+|([。！？।])"
_BULLET, _OUTER = r"^\s*[\-+*•]\s+", r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$"


class Cut:
    """The passages of a batch of texts as Arrow columns; nothing is done text by text."""

    def __init__(self, texts: pa.Array):
        lines = pc.split_pattern(_mask(texts), "\n")
        owner, line = pc.list_parent_indices(lines), pc.list_flatten(lines)
        formatted = pc.match_substring_regex(line, FORMATTED)
        bare = pc.replace_substring_regex(pc.replace_substring_regex(line, _BULLET, ""), _OUTER, "")
        parts = pc.split_pattern(pc.if_else(formatted, bare, pc.replace_substring_regex(bare, _SENTENCE_END, "\\1\\2\n")), "\n")
        at, p = pc.list_parent_indices(parts), pc.replace_substring_regex(pc.list_flatten(parts), _OUTER, "")
        keep = pc.not_equal(p, "")
        at = at.filter(keep)
        self.p, self.formatted, self.owner = p.filter(keep), formatted.take(at), owner.take(at).to_numpy()
        # the passages beside each, in short records
        n = len(self.p)
        sizes = np.bincount(self.owner, minlength=len(texts))[self.owner] if n else np.zeros(0, np.int64)
        self.short = sizes <= SHORT
        self.n = pa.array(sizes, mask=~self.short)
        joined = np.concatenate([[False], self.owner[1:] == self.owner[:-1], [False]]) if n else np.zeros(1, bool)
        place = np.arange(n)
        self.before, self.after = (self._beside(np.where(self.short & has, place + d, n)) for has, d in ((joined[:-1], -1), (joined[1:], 1)))

    def _beside(self, at: np.ndarray) -> pa.Array:
        """The passage at a place, '' beyond the record, null in longer records."""
        got = pa.concat_arrays([self.p, pa.array([""], pa.string())]).take(pa.array(at))
        return pc.if_else(pa.array(self.short), got, pa.nulls(len(at), pa.string()))

    def keys(self) -> list[np.ndarray]:
        """128 bits of each passage with its surroundings."""
        coded = self.p.dictionary_encode()
        words, code = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        out = []
        for salt in ("segforge-passage", "segforge-context"):
            h = np.concatenate([pd.util.hash_array(words, hash_key=salt, categorize=False), np.array([1], np.uint64)])
            own, none = h[code], len(words)
            joined = self.owner[1:] == self.owner[:-1]
            before = np.where(self.short & np.concatenate([[False], joined])[: len(code)], np.concatenate([[none], code])[: len(code)], none)
            after = np.where(self.short & np.concatenate([joined, [False]])[: len(code)], np.concatenate([code[1:], [none]])[: len(code)], none)
            number = np.where(self.short, self.n.fill_null(0).to_numpy(), 0).astype(np.uint64) * np.uint64(2) + self.formatted.to_numpy(zero_copy_only=False).astype(np.uint64)
            mixed = own
            for x in (number, h[before], h[after]):
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed ^ (mixed >> np.uint64(32))).view(np.int64))
        return out


def _mask(texts: pa.Array) -> pa.Array:
    """File names, numbers from 400 to 599 and other numbers, each one sign."""
    for pattern, sign in ((_FILE_NAME, "\x02"), (r"\b[45]\d\d\b", "\x03"), (r"\d+", "0")):
        texts = pc.replace_substring_regex(texts, pattern, sign)
    return texts


def _texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    docs = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.where("text is not null and trim(text) <> ''")


def cut(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, k1, k2``: the keys of each record's passages."""

    def run(batches):
        for batch in batches:
            made = Cut(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(made.owner)), *map(pa.array, made.keys())], names=["doc_id", "k1", "k2"])

    return _texts(documents, key, text).mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint")


def passages(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each distinct passage with its number of occurrences; ``n, before, after`` are null in longer records."""

    def run(batches):
        for batch in batches:
            made = Cut(batch.column("text"))
            k1, k2 = made.keys()
            table = pa.table({"k1": k1, "k2": k2, "i": np.arange(len(k1))}).group_by(["k1", "k2"]).aggregate([("i", "min"), ("i", "count")]).combine_chunks()
            at = table["i_min"].combine_chunks()
            columns = [table["k1"].combine_chunks(), table["k2"].combine_chunks(), *(c.take(at) for c in (made.p, made.formatted, made.n, made.before, made.after)), table["i_count"].combine_chunks()]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "p", "formatted", "n", "before", "after", "times"])

    each = _texts(documents, key, text).mapInArrow(run, "k1 bigint, k2 bigint, p string, formatted boolean, n bigint, before string, after string, times bigint")
    return each.groupBy("k1", "k2", "p", "formatted", "n", "before", "after").agg(F.sum("times").alias("times"))


def trusted(passage: str, formatted: bool) -> int:
    """Kind of a passage that is marked beyond doubt, else 0."""
    if formatted or QUOTED.search(passage):
        return 0
    if STATUS.search(passage) or UNAVAILABLE.search(passage):
        return 2
    if SCRIPTS.search(passage):
        return 3
    if FILLER.search(passage):
        return 4
    return int(bool(_MAY_HOLD_SLOT.search(passage) and TO_FILL.search(passage) and sum(c.isalpha() for c in TO_FILL.sub("", passage)) >= 2))


def admissible(passage: str, formatted: bool) -> int:
    """The exact check, as bits: 1 for placeholders, 2 for the other kinds."""
    if formatted:
        return 0
    slot = bool(_MAY_HOLD_SLOT.search(passage) and SLOT.search(passage) and sum(c.isalpha() for c in SLOT.sub("", passage)) >= 2)
    return int(slot) + 2 * (not QUOTED.search(passage))


def words_of(passage: str) -> list[str]:
    """Words and pairs of words; slots and quotes are one word each, unspaced scripts give pairs of characters, or three where
    they write vowels."""
    lead, words = [], []
    if _MAY_HOLD_SLOT.search(passage):
        passage, n = SLOT.subn(" \x04 ", passage)
        lead += ["\x00slot"] * min(n, 1)
    if QUOTED.search(passage):
        lead.append("\x00quote")
    if not passage.isascii():
        for run in _UNSPACED.findall(passage):
            size = 3 if run[0] < "\u0f00" else 2
            words += [run[i : i + size] for i in range(max(1, len(run) - size + 1))]
        passage = _UNSPACED.sub(" ", passage)
        spaced = _WORD.findall(passage.lower())
    else:
        spaced = _ASCII_WORD.findall(passage.lower())
    return lead + words + [w for w in spaced if w != "\x04"] + [f"{a} {b}" for a, b in zip(spaced, spaced[1:])]


def script_of(word: str) -> int:
    """Number of a word's script; marks and surroundings have their own."""
    c = ord(word[0])
    if c == 0:
        return 0
    return next((i for i, end in enumerate(_SCRIPT_ENDS, 1) if c < end), len(_SCRIPT_ENDS) + 1)


class _Cells(dict):
    """Cells of words met by a task. The cells of one script lie together, so that a kind's shares can be taken within it."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MET:
            self.clear()
        got = self[word] = script_of(word) * CELLS + zlib.crc32(word.encode("utf-8", "replace")) % CELLS
        return got


_CELLS = _Cells()


def features(passage: str, formatted: bool, n: int | None, before: str | None, after: str | None) -> tuple[list[int], int]:
    """(cells of the words and then of the surroundings, number of the latter)."""
    around = ["\x00line"] if formatted else []
    if n is not None:
        around += [f"\x00of{n}", f"\x00by{before}", f"\x00by{after}"]
    return [_CELLS[w] for w in words_of(passage) + around], len(around)


def distinct_passages(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k1, k2, features, around, kind, may, n``: each distinct passage once, with its trusted kind. Of passages that are common in
    longer records too only the words count."""

    def run(batches):
        for batch in batches:
            ps, fs, ns, before, after = (batch.column(c).to_pylist() for c in ("p", "formatted", "n", "before", "after"))
            made = [features(*x) for x in zip(ps, fs, ns, before, after)]
            columns = [
                batch.column("k1"), batch.column("k2"), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.int32()),
                pa.array([trusted(p, f) for p, f in zip(ps, fs)], pa.int32()), pa.array([admissible(p, f) for p, f in zip(ps, fs)], pa.int32()), batch.column("times"),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "features", "around", "kind", "may", "n"])

    each = materialise(passages(documents, key, text))
    longer = F.sum(F.when(F.col("n").isNull(), F.col("times")).otherwise(0)) / F.sum("times")
    common = each.groupBy("p").agg((longer >= COMMON).alias("common"))
    alone = lambda c: F.when(~F.col("common"), F.col(c)).alias(c)
    told = each.join(common, "p").select("k1", "k2", "p", "formatted", alone("n"), alone("before"), alone("after"), "times")
    return told.mapInArrow(run, "k1 bigint, k2 bigint, features array<int>, around int, kind int, may int, n bigint")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cells, their passage, whether they are words, number of passages) from the list column's buffers."""
    column = batch.column("features")
    offsets = column.offsets.to_numpy()
    cells = column.values.to_numpy()[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(cells)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    return cells, owner, place < (sizes - batch.column("around").to_numpy())[owner], len(sizes)


def posteriors(batch: pa.RecordBatch, model: np.ndarray) -> np.ndarray:
    """Posterior of each kind for each passage."""
    cells, owner, is_word, n = _arrays(batch)
    worth = _WORTH[cells // CELLS]
    words = np.bincount(owner[is_word], weights=worth[is_word], minlength=n)
    odds = (model[1:] - model[0])[:, cells] * worth
    add = lambda part: np.stack([np.bincount(owner[part], weights=o[part], minlength=n) for o in odds], axis=1)
    scores = add(is_word) * np.minimum(1.0, WORDS_COUNT / np.maximum(words, 1))[:, None] + np.minimum(add(~is_word), AROUND)
    scores = np.concatenate([np.zeros((n, 1)), scores], axis=1) + PRIOR
    out = np.exp(scores - scores.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def membership(batch: pa.RecordBatch, model: np.ndarray | None) -> np.ndarray:
    """Weight of each passage in each kind: trusted ones are fixed; others are sound before there is a model."""
    kinds = batch.column("kind").to_numpy()
    weights = np.zeros((len(kinds), len(KINDS)))
    if model is not None:
        weights[:] = posteriors(batch, model)
        weights[:, 1:][weights[:, 1:] < TEACHES] = 0
    weights[:, 0] = 1 - weights[:, 1:].sum(axis=1)
    weights[kinds > 0] = np.eye(len(KINDS))[kinds[kinds > 0]]
    return weights


def sums_of(batch: pa.RecordBatch, model: np.ndarray | None, total: np.ndarray) -> None:
    """Adds the expected counts of each kind."""
    weights = membership(batch, model) * batch.column("n").to_numpy()[:, None]
    cells, owner, _, _ = _arrays(batch)
    for k in range(len(KINDS)):
        total[k] += np.bincount(cells, weights=weights[owner, k], minlength=BUCKETS)


def _sums(table: DataFrame, model: np.ndarray | None) -> np.ndarray:
    """Expected word counts of each kind. Kinds times buckets reach the driver."""
    shared = table.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches):
        total = np.zeros((len(KINDS), BUCKETS))
        for batch in batches:
            if batch.num_rows:
                sums_of(batch, shared.value, total)
        rows, buckets = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(buckets.astype(np.int32)), pa.array(total[rows, buckets])], names=["kind", "bucket", "n"])

    got = table.mapInArrow(run, "kind int, bucket int, n double").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(KINDS), BUCKETS))
    if got.num_rows:
        out[got["kind"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def model_of(sums: np.ndarray) -> np.ndarray:
    """Log probabilities of the cells within their script, so that no kind is told by its languages: each kind's own shares
    with a part of everything's. What few words a kind has of a script count for less."""
    by_script = sums.reshape(len(KINDS), SCRIPTS_NUMBER, CELLS)
    every = by_script.sum(axis=0) + 1e-3
    every = every / every.sum(axis=1, keepdims=True)
    size = by_script.sum(axis=2, keepdims=True)
    own = np.maximum(by_script - ONCE, 0) / (size + FEW)
    return np.log((1 - BACKGROUND) * own + BACKGROUND * every).reshape(len(KINDS), BUCKETS).astype(np.float32)


def fit(table: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The model after so many rounds at most, from a table of distinct passages."""
    sums = _sums(table, None)
    for _ in range(rounds):
        new = _sums(table, model_of(sums))
        moved = np.abs(new - sums)[1:].sum() / max(1.0, new[1:].sum())
        sums = new
        if moved < SETTLED:
            break
    return model_of(sums)


def scored(table: DataFrame, model: np.ndarray) -> DataFrame:
    """``k1, k2, kind, score`` of the distinct passages that are residue."""
    shared = table.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            post = posteriors(batch, shared.value)
            may = batch.column("may").to_numpy()
            post[(may & 1) == 0, 1] = 0
            post[(may & 2) == 0, 2:] = 0
            best = post[:, 1:].argmax(axis=1) + 1
            score = post[:, 1:].sum(axis=1)
            keep = np.flatnonzero(score >= THRESHOLD)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(at), batch.column("k2").take(at), pa.array([KINDS[k] for k in best[keep]], pa.string()), pa.array(score[keep])], names=["k1", "k2", "kind", "score"])

    return table.mapInArrow(run, "k1 bigint, k2 bigint, kind string, score double")


def judged(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, kinds, score`` of residue records: the kinds of their passages and the best score."""
    table = materialise(distinct_passages(documents, key, text))
    bad = scored(table, fit(table))
    hits = cut(documents, key, text).join(bad, ["k1", "k2"])
    return hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.max("score").alias("score"))


def found(documents: DataFrame) -> DataFrame:
    return judged(documents).select("doc_id")


def kept(documents: DataFrame) -> DataFrame:
    """The documents without residue; rows, repeats and blank texts stay."""
    bad = found(documents)
    return documents.join(bad, documents["doc_id"] == bad["doc_id"], "left_anti")
