"""Sentence boundaries across languages and scripts, disambiguated by the document itself.

Whether a period ends a sentence is told by its neighbours' unambiguous occurrences: a word that ends texts can end a
sentence, one that is followed by a comma, a number or a word that never starts texts is an abbreviation; a word that
starts texts can start a sentence, one that is seen with a capital in mid-sentence is a name. The same document's
evidence alone is used where its unambiguous occurrences are enough, else the corpus' for that language. Evidence is counted over all texts before
the shuffle; only the evidence about words at doubtful places is joined to these places.

Scripts have their own terminators; a sentence quoted or bracketed in a larger one is no unit; closing marks belong to
the sentence that they close, a list number to the one that it leads; empty lines end a sentence, single line breaks
don't by themselves. Thai has no mark: a space between two Thai letters parts sentences, spaces around foreign words and
numbers don't.

Offsets are code points from 0 of a sentence's first character and just after its last, without outer white space.
Defined results: null, empty and blank texts have no sentences. A text without language gets the rules all languages
share. Texts of any length are cut whole. Re-sent units count once. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.io import materialise, skew_join
from segforge.llm import ngrams

# Terminators by kind.
STOP = ".．"
ALWAYS = "。｡।॥۔"
ASK = "!?！？؟‽"
DOTS = "…"
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "〈": "〉", "《": "》", "‹": "›", "‚": "‘’", "‘": "’"}
CLOSERS = set("”“»」』)）]】〉》›’‘\"'")
ROUND = set("(（[【")
NEVER_BEFORE = set(",;:，；：、،؛)]）】」』”»–—-/&+%")
_TERMINAL = re.compile("[.．。｡।॥۔!?！？؟‽…]+|\n[^\\S\n]*(?:\n[^\\S\n]*)+")
_TOKEN = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}._\-/]*[\p{L}\p{M}\p{N}])?\p{M}*")
_RUN = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}._\-/]*")
_FILE = re.compile(r".*(?:[\d_/\-]|\w{3,})[^.]*\.[A-Za-z]\w{1,9}$")
_LISTED = re.compile(r"\s*\d{1,2}[.)]\s")
_THAI_GAP = re.compile("(?<=[\u0e00-\u0e7f])[^\\S\n]*(?:\n[^\\S\n]*)?(?<=\\s)(?=[\u0e00-\u0e7f])")
_CASELESS = re.compile("[\u0590-\u08ff\u0900-\u0dff\u0e00-\u0effက-႟ក-\u17ff\u3040-ヿ㐀-鿿가-\ud7af]")
_UNSPACED = re.compile("[\u0e00-\u0effက-႟ក-\u17ff\u3040-ヿ㐀-鿿々]")
#: Languages that write ordinals with a period.
ORDINALS = {"de", "pl"}
NUMBER, FILE = "\x01n", "\x01f"
#: Characters of a token from which its digest stands for it; memory only.
LONG = 40
#: Distinct words a task counts before it passes on its sums; memory only.
FLUSH = 300_000
#: Unambiguous occurrences in the document from which its evidence stands alone.
ENOUGH = 3


def shape_of(token: str) -> str:
    """The token that evidence is kept about; numbers and file names are one each, long tokens stand by 128 bits of theirs."""
    if token[0].isdigit() and not any(c.isalpha() for c in token):
        return NUMBER
    if _FILE.match(token):
        return FILE
    return token if len(token) <= LONG else "\x01h" + hashlib.blake2b(token.encode("utf-8", "replace"), digest_size=16).hexdigest()


def pairs_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Matched quotes and brackets of a paragraph, outermost first in order."""
    stack: list[tuple[str, int]] = []
    found = []
    straight = -1
    for i in range(start, end):
        c = text[i]
        if c == '"':
            if straight < 0:
                straight = i
            else:
                found.append((straight, i))
                straight = -1
            continue
        hit = next((k for k in range(len(stack) - 1, -1, -1) if c in PAIRS[stack[k][0]]), None) if c in CLOSERS else None
        if hit is not None and not (c in "’‘" and i + 1 < end and text[i + 1].isalpha()):
            found.append((stack[hit][1], i))
            del stack[hit:]
        elif c in PAIRS and not (c in "‘’‚" and i and text[i - 1].isalnum()):
            stack.append((c, i))
    return found


class Place:
    """A place where a sentence may end. ``cut``: after closing marks. ``sure``: None where evidence decides."""

    __slots__ = ("cut", "sure", "word", "at", "following", "kind")

    def __init__(self, cut: int, sure: bool | None, word: str = "", at: int = -1, following: str = "", kind: str = ""):
        self.cut, self.sure, self.word, self.at, self.following, self.kind = cut, sure, word, at, following, kind


def first_token(text: str, at: int) -> str:
    while at < len(text) and not (text[at].isalnum()):
        at += 1
    m = _TOKEN.match(text, at)
    return m.group() if m else ""


def places(text: str, lang: str | None) -> list[Place]:
    out: list[Place] = []
    n = len(text)
    if lang == "th":
        out += [Place(m.end(), True, kind="gap") for m in _THAI_GAP.finditer(text) if m.end() > m.start()]
    starts = [0]
    marks = list(_TERMINAL.finditer(text))
    starts += [m.end() for m in marks if m.group()[0] == "\n"]
    bounds = [*starts, n]
    inside: dict[int, int] = {}
    opener: dict[int, int] = {}
    if any(c in PAIRS or c == '"' for c in text):
        for a, b in zip(bounds, bounds[1:]):
            for o, c in pairs_of(text, a, b):
                opener[c] = o
    spans = sorted((o, c) for c, o in opener.items())
    opens, reach = [o for o, _ in spans], list(accumulate((c for _, c in spans), max))  # farthest end of those that open so far
    runs = [m.span() for m in _RUN.finditer(text)]
    run_starts = [a for a, _ in runs]
    for m in marks:
        i, k = m.start(), m.end()
        if m.group()[0] == "\n":
            out.append(Place(k, True, kind="paragraph"))
            continue
        closed = -1
        while k < n and text[k] in CLOSERS and (k in opener or text[k] not in "“‘\"'"):
            if k in opener and opener[k] < i:
                closed = opener[k]
            k += 1
        held = bisect_left(opens, i)
        if held and reach[held - 1] >= k:
            continue
        after = k
        while after < n and text[after].isspace():
            after += 1
        gap, nxt = after > k, text[after] if after < n else ""
        if not nxt:
            out.append(Place(k, True, kind="end"))
            continue
        if text[k:after].count("\n") > 1:
            continue
        if nxt in NEVER_BEFORE and not (nxt in "–—-" and gap and after + 1 < n and text[after + 1].isspace() and text[k:after].count("\n") == 1):
            continue
        run = bisect_right(run_starts, i - 1) - 1
        word_at = run_starts[run] if run >= 0 and runs[run][1] >= i else i
        out += _judge(text, lang, m.group(), i, k, after, gap, nxt, closed, word_at)
    out.sort(key=lambda p: p.cut)
    return out


def _judge(text: str, lang: str | None, mark: str, i: int, k: int, after: int, gap: bool, nxt: str, closed: int, at: int) -> Iterator[Place]:
    following = first_token(text, after)
    lead = following[:1] or nxt
    upper, lower, digit = lead.isupper() or unicodedata.category(lead) == "Lt", lead.islower(), lead.isdigit()
    caseless = bool(_CASELESS.match(lead))
    word = text[at:i]
    if closed >= 0 and text[closed] not in ROUND:
        # a quotation ends here: it may be the end of its sentence or a part of it
        if (lower and not gap) or (caseless and _UNSPACED.match(lead) and not gap and not (lang == "zh" and closed and text[closed - 1] in ":：")):
            return
        yield Place(k, None if lower or (caseless and gap) else True, "\"", closed, following, "quote")
        return
    if mark[-1] in ALWAYS or (mark[-1] in "．" and not digit):
        yield Place(k, True, kind="stop")
    elif any(c in ASK for c in mark):
        if not gap and not (upper or caseless or nxt in PAIRS or digit and mark[-1] in "！？"):
            return
        foreign = lower and bool(_CASELESS.match(text[i - 1])) if i else False
        yield Place(k, None if lower and not foreign else True, "!", i, following, "ask")
    elif DOTS in mark or len(mark) > 1:
        if gap and upper:
            yield Place(k, True, kind="dots")
        elif gap and lower:
            yield Place(k, None, "…", i, following, "dots")
    else:
        if not gap:
            if digit or not word or closed >= 0:
                if closed >= 0 and upper:
                    yield Place(k, True, kind="stop")
                return
            second = text[after + 1 : after + 2]
            starts = upper and (second.islower() or second.isspace() or (following.isupper() and len(following) > 3))
            glued = (starts or caseless or nxt in PAIRS) and len(word.rpartition(".")[2]) > 1 or (word[-1].isdigit() and (upper or caseless))
            if glued and (text[i - 1].islower() or text[i - 1].isdigit() or _CASELESS.match(text[i - 1]) or word[-2:].isupper()):
                yield Place(k, None, word, at, following, "glued")
            return
        if not word:
            yield Place(k, True, kind="stop")
        elif closed >= 0:
            yield Place(k, None if lower or digit else True, ")", i, following, "ask")
        else:
            yield Place(k, None, word, at, following, "period")


class Evidence:
    """Counts about a word: as w before a period, as x after one."""

    __slots__ = ("ends", "goes_on", "dots", "starts", "mid")

    def __init__(self, ends=0, goes_on=0, dots=0, starts=0, mid=0):
        self.ends, self.goes_on, self.dots, self.starts, self.mid = ends or 0, goes_on or 0, dots or 0, starts or 0, mid or 0


def decide(place: Place, start: int, text: str, lang: str | None, w: Evidence, x: Evidence) -> bool:
    """Whether a sentence that began at ``start`` ends at a doubtful place."""
    lead = place.following[:1]
    lower, digit, caseless = lead.islower(), lead.isdigit(), bool(_CASELESS.match(lead)) if lead else False
    starter = x.starts > 0 and x.starts >= x.mid
    if place.kind == "quote":
        return place.at != start and (starter or not lower)
    if place.kind in ("ask", "dots"):
        return starter if lower else True
    word = place.word
    number = shape_of(word) == NUMBER
    if number and place.at == start and len(word) <= 3:
        return False
    if number:
        if lower:
            return starter
        if lang in ORDINALS and len(word) <= 2 and not starter and not digit:
            return False
        return True
    free = w.mid + w.starts >= 2 * w.dots and w.goes_on <= w.dots / 2  # mostly without a period
    letters = sum(c.isalpha() for c in word)
    rare = letters >= 5 and w.dots < ENOUGH  # too long and too seldom for an abbreviation
    if lower:
        return starter and (w.ends > 0 or free or rare)
    if place.kind == "glued":
        return w.ends > 0 or w.dots == 0
    if w.ends == 0:
        if free and w.dots and not digit and len(word) > 1:
            return True
        if w.dots >= ENOUGH:
            return False
        if rare and starter:
            return True
        return not (letters <= 1 or w.goes_on > 0 or "." in word or (letters <= 4 and not starter and w.dots > 0))
    if digit:
        return w.goes_on <= 3 * w.ends
    if 3 * w.goes_on <= w.ends or caseless:
        return True
    return not (x.mid > 0 and x.starts == 0)


def cut(text: str, lang: str | None, evidence, after=None) -> list[tuple[int, int]]:
    """Offsets of the sentences; ``evidence(word)`` gives what is known about a word, ``after(word)`` what is known about
    it after a period, where that differs."""
    after = after or evidence
    out, start, n = [], 0, len(text)

    def skip(i: int) -> int:
        while i < n and text[i].isspace():
            i += 1
        return i

    start = skip(0)
    for p in places(text, lang):
        if p.cut <= start:
            continue
        if p.sure is None and not decide(p, start, text, lang, evidence(shape_of(p.word)) if p.word else Evidence(), after(shape_of(p.following)) if p.following else Evidence()):
            continue
        end = p.cut
        while end > start and text[end - 1].isspace():
            end -= 1
        if end > start and any(c.isalnum() for c in text[start:end]):
            out.append((start, end))
            start = skip(p.cut)
    end = n
    while end > start and text[end - 1].isspace():
        end -= 1
    if end > start:
        if out and not any(c.isalnum() for c in text[start:end]):
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


COUNTS = ["ends", "goes_on", "dots", "starts", "mid"]


def observe(text: str, counts: Counter, key: tuple) -> None:
    """Unambiguous occurrences of a text's words."""
    previous = None
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        token = shape_of(m.group())
        gap = text[previous:a] if previous is not None else ""
        if previous is None or gap.count("\n") > 1:
            counts[key, token, "starts"] += 1
        elif gap == " ":
            counts[key, token, "mid"] += 1
        previous = b
        if text[b : b + 1] == "." and text[b + 1 : b + 2] not in (".",):
            k = b + 1
            while k < len(text) and text[k] in CLOSERS:
                k += 1
            rest = text[k : k + 3]
            bare = rest.lstrip()
            if not bare or rest[:2] == "\n\n":
                if not text[k:].strip() or rest[:2] == "\n\n":
                    counts[key, token, "ends"] += 1
                    counts[key, token, "dots"] += 1
            elif rest[0].isspace():
                counts[key, token, "dots"] += 1
                if bare[0].islower() or (bare[0].isdigit() and not _LISTED.match(text, k)):
                    counts[key, token, "goes_on"] += 1
            elif k == b + 1 and rest[0] in ",;:،":
                counts[key, token, "dots"] += 1
                counts[key, token, "goes_on"] += 1


def evidence_of(texts: DataFrame) -> DataFrame:
    """``lang, doc, word`` and counts; doc is null for the corpus' sums. ``texts``: lang, doc, text; documents are
    counted for themselves where doc isn't null. Each text is looked at once."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            table: dict[tuple, dict] = {}
            for (key, word, what), v in counts.items():
                table.setdefault((*key, word), {})[what] = v
            counts.clear()
            rows = list(table.items())
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([k[2] for k, _ in rows], pa.string()), *[pa.array([v.get(c, 0) for _, v in rows], pa.int64()) for c in COUNTS]],
                names=["lang", "doc", "word", *COUNTS],
            )

        for batch in batches:
            for lang, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    observe(text, counts, (lang, doc))
            if len(counts) > FLUSH:
                yield flush()
        if counts:
            yield flush()

    raw = texts.select("lang", "doc", "text").mapInArrow(run, "lang string, doc bigint, word string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    sums = [F.sum(c).alias(c) for c in COUNTS]
    each = materialise(raw.groupBy("lang", "doc", "word").agg(*sums))
    corpus = each.groupBy("lang", "word").agg(*sums).select("lang", F.lit(None).cast("bigint").alias("doc"), "word", *COUNTS)
    return corpus.unionByName(each.where("doc is not null"))


def doubts(texts: DataFrame) -> DataFrame:
    """``id, lang, doc, word``: words at doubtful places, once for each text."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, lang, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text:
                    words = {w for p in places(text, lang) if p.sure is None for w in (p.word, p.following) if w}
                    rows += [(key, lang, doc, w) for w in {shape_of(w) for w in words}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())], names=["id", "lang", "doc", "word"])

    return texts.select("id", "lang", "doc", "text").mapInArrow(run, "id bigint, lang string, doc bigint, word string")


def sentences(texts: DataFrame, everything: DataFrame) -> DataFrame:
    """``id, start_char, end_char`` of all sentences. ``texts``: id (unique), lang, doc, text. ``everything``: lang, doc,
    text of the whole corpus that gives evidence."""
    known = evidence_of(everything)
    places_ = materialise(doubts(texts))
    wanted = places_.select("lang", "word").distinct()
    known = known.join(wanted, (known.lang.eqNullSafe(wanted.lang)) & (known.word == wanted.word), "left_semi")
    key = F.coalesce("lang", F.lit("")).alias("lang")
    corpus = known.where("doc is null").select(key, "word", *[F.col(c).alias(f"c_{c}") for c in COUNTS])
    own = known.where("doc is not null").select(key, "doc", "word", *[F.col(c).alias(f"d_{c}") for c in COUNTS])
    joined = skew_join(places_.withColumn("lang", key), corpus, ["lang", "word"], F.col("id"), how="left")
    joined = skew_join(joined, own, ["lang", "doc", "word"], F.col("id"), how="left")
    # a period before a capital is no evidence by itself: a document decides by what its unambiguous occurrences tell
    as_before = F.coalesce(F.expr(f"d_ends + d_goes_on >= {ENOUGH} or d_starts + d_mid >= greatest({ENOUGH}, 2 * d_dots)"), F.lit(False))
    as_after = F.coalesce(F.expr(f"d_starts + d_mid >= {ENOUGH}"), F.lit(False))
    one = lambda enough, c: F.when(enough, F.col(f"d_{c}")).otherwise(F.coalesce(f"c_{c}", F.lit(0)))
    both = [*[one(as_before, c).alias(c) for c in COUNTS], *[one(as_after, c).alias(f"x_{c}") for c in ("starts", "mid")]]
    facts = joined.groupBy("id").agg(F.collect_list(F.struct("word", *both)).alias("facts"))
    full = texts.select("id", "lang", "text").join(facts, "id", "left")

    def run(batches):
        for batch in batches:
            rows = []
            for key, lang, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                if text and text.strip():
                    table = {f["word"]: Evidence(*[f[c] for c in COUNTS]) for f in found or []}
                    after = {f["word"]: Evidence(starts=f["x_starts"], mid=f["x_mid"]) for f in found or []}
                    none = Evidence()
                    rows += [(key, a, b) for a, b in cut(text, lang, lambda w: table.get(w, none), lambda x: after.get(x, none))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["id", "start_char", "end_char"])

    return full.mapInArrow(run, "id bigint, start_char bigint, end_char bigint")


def found(units: DataFrame, files: DataFrame, params: DataFrame) -> DataFrame:
    """``unit_key, start_char, end_char`` of the units of files that were converted without cutting paragraphs."""
    whole = params.where("paragraph = 'yes'").select(F.col("file_id").cast("bigint")).distinct().withColumn("whole", F.lit(True))
    langs = files.select(F.col("file_id").cast("bigint"), ngrams.primary(F.col("source_language")).alias("lang")).groupBy("file_id").agg(F.min("lang").alias("lang"))
    marked = langs.join(whole, "file_id", "full")
    slim = units.select(F.col("unit_key").cast("bigint").alias("id"), F.col("file_id").cast("bigint"), F.coalesce(F.when(F.col("original").isNotNull(), F.xxhash64("original")), F.xxhash64("file_id")).alias("document"), F.col("source").alias("text")).where("text is not null and trim(text) <> ''")
    every = skew_join(slim, marked, ["file_id"], F.col("id"), how="left").withColumn("doc", F.when(F.col("whole"), F.col("document")))
    texts = every.where("whole").groupBy("id").agg(F.min(F.struct("text", "lang", "doc")).alias("t")).select("id", "t.lang", "t.doc", "t.text")
    return sentences(materialise(texts), every).select(F.col("id").alias("unit_key"), "start_char", "end_char")
