"""Text that was read with the wrong character encoding: find it and restore it.

A channel is a pair of encodings: the one by which the bytes were read and their own. For a suspicious text every
channel of its language is tried. Between two one-byte encodings Viterbi search over the tokens leaves or decodes each, as the
corpus' word frequencies like best. UTF-8 channels replace every well-formed sequence; one lost byte (U+FFFD) of it is
filled by trigrams, more are given up. Channels of the other many-byte encodings decode the whole text. Texts of files without
language are tried by UTF-8 channels only. A text counts as garbled if the best channel
turns unheard-of sequences into common ones, or if it holds remains that sound text never has: replacement characters,
C1 controls or question marks within words. A text in which nothing is odd counts if it has a run of rare trigrams and a channel
makes the changed part far likelier.

Frequencies come from all sources that look sound, hashed into a table of fixed size for each language.

Defined results: null, empty and ASCII texts without lost characters are sound. Texts of a language without model are
judged by the language that suits the decoded text best. Repeated rows have the same result; re-sent units count once. Extra columns are
ignored. Where bytes are lost the restored text keeps U+FFFD unless the wildcard has one likely filling.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.io import skew_join
from segforge.llm import ngrams

# Letters beyond ASCII that a language's own text uses.
LETTERS = {
    "en": "éïñçèêöüàôÉ", "de": "äöüßÄÖÜẞéàè", "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ", "es": "áéíóúüñÁÉÍÓÚÜÑ¿¡ªº", "pt": "áâãàçéêíóôõúüÁÂÃÀÇÉÊÍÓÔÕÚÜªº",
    "pl": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "ru": "А-яЁё", "ja": "ぁ-ゟァ-ヿ々〆〇一-鿿", "zh": "々〇一-鿿", "th": "ก-๛", "ar": "\u0600-ۿ", "hi": "\u0900-ॿ",
}
#: Punctuation, symbols, marks and width variants that sound text of any language may hold.
COMMON = "\x00-\x7f\xa0\xa7\xa9\xab\xad\xae\xb0\xb1\xb5\xb7\xbb\xbd\xd7\u2000-‟†-•…-\u202f‰′″‹›\u2060-\u206f€№™←-↓✓✔✗\u3000-〟\uff00-\uffef\u0300-\u036f\u3099\u309a\ufe00-\ufe0f\ufeff\U0001f300-\U0001faff"
# Look-alike letters that may stand in sound text (they are another problem).
TWINS = "АВЕЅІЈКМНОРСТУХаеорсухѕіјһΑΒΕΖΗΙΚΜΝΟΡΤΥΧονµ"
ODD = {lang: re.compile(f"[^{COMMON}{letters}{TWINS}]|(?<=[^\\W\\d_])[‚„†‡•‰‹˜ˆ…™°±§©®](?=[^\\W\\d_])") for lang, letters in LETTERS.items()}
# Texts of unknown language: letters that open or close UTF-8 sequences in misread text.
ODD[None] = re.compile("[ÃÂÐÑØÙàâãäåæçèéÔΓ├┬ÄČĂРСЃЂ鈥\ufffd\x80-\x9f][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ\u00a0-¿ÇñºÑáíóú│┤╡╢╖╕╣║╗╝╜╛┐└┴┬├─┼╞╟]")
LATIN_LETTERS = set("".join(LETTERS[x] for x in ("en", "de", "fr", "es", "pt"))) | set("«»¿¡ªº°§©®±µ·½×\xa0\xad")
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uff61-\uff9f\ue000-\uf8ff]")
_HIGH, _HIGH_TRAILED = re.compile("[^\x00-\x7f]+"), re.compile("(?:[^\x00-\x7f]+[\x00-\x7f]?)+")
CERTAIN = re.compile("[�\x80-\x84\x86-\x9f]")
_LOST_INSIDE = re.compile(r"(?<=[^\W\d_])\?+(?=[^\W\d_])")
_LOST_RUN = re.compile(r"\?{2,}")
_LOST_LEAD = re.compile(r"(?:^|(?<=[\s(]))\?+(?=[^\W_])")
_ADDRESS = re.compile(r"\S*(?:://|www\.|[=&/])\S*")
#: Languages without spaces: what stands between spaces there is no word.
UNSPACED = {"ja", "zh", "th"}
#: Scripts in which whole words of question marks are the usual loss.
OWN = {lang: re.compile(f"[{LETTERS[lang]}]") for lang in ("ru", "ja", "zh", "th", "ar", "hi")}
# Encodings by which bytes are commonly misread, and the own encodings of each language's files.
READ_AS = ["cp1252", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2", "cp1256", "cp874", "gb18030", "cp932", "euc_jp", "big5"]
OWN_AS = {
    "en": ["utf-8", "cp1252", "mac_roman", "cp850"], "de": ["utf-8", "cp1252", "mac_roman", "cp850"], "fr": ["utf-8", "cp1252", "mac_roman", "cp850"],
    "es": ["utf-8", "cp1252", "mac_roman", "cp850"], "pt": ["utf-8", "cp1252", "mac_roman", "cp850"], "pl": ["utf-8", "cp1250", "iso8859_2", "cp852", "mac_latin2"],
    "ru": ["utf-8", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic"], "ja": ["utf-8", "cp932", "euc_jp"], "zh": ["utf-8", "gb18030", "big5"],
    "th": ["utf-8", "cp874"], "ar": ["utf-8", "cp1256", "iso8859_6"], "hi": ["utf-8"],
}
MANY_BYTES = {"utf-8", "gb18030", "cp932", "euc_jp", "big5"}
#: A decoding counts when it removes so many unheard-of trigrams, and so large a share of the changed characters.
LEAST_GAIN, GAIN_SHARE, LEFT_SHARE = 2, 0.5, 0.5
#: A trigram is rare below this share of the count that a trigram of the language's sound text has on average; a text in its
#: own script is looked at where so many rare ones follow each other, and is garbled where so many trigrams change and the new ones are
#: likelier by so much (mean of logarithms). Shares, as the corpus holds the garbled texts too.
RARE, RARE_RUN, LEAST_CHANGED, LIKELIER = 0.05, 4, 4, 3.0
SWITCH, UNKNOWN_WORD = 2.0, -15.0
#: What each byte after the first of a complete sequence is worth by itself, and ways that the search through a lattice keeps at each byte.
WELL_FORMED, WAYS = 4.0, 4
#: Texts whose answers a task remembers; memory only.
KNOWN = 50_000
#: Ways that are kept where they are equally good.
EQUALS = 256
#: Channels are searched whose cheap view has at most so many unheard-of trigrams more than the best.
NEAR = 0.5
#: Encodings by which text may have been misread a second time.
TWICE = ("cp1252", "mac_roman", "cp850")
#: Share of the usual log odds from which a trigram is no more unheard-of.
HEARD = 0.2


@lru_cache(maxsize=None)
def bytes_by(encoding: str) -> dict[str, int]:
    """Bytes of the characters of a one-byte encoding; a byte without a character is the C1 control of its number, as
    lenient readers have it."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        table.setdefault(chr(b), b)
    return table


@lru_cache(maxsize=None)
def byte_view(encoding: str) -> dict[int, int | str]:
    """Translation of text to its bytes as Latin-1; what the encoding doesn't have leaves that range."""
    view: dict[int, int | str] = {b: chr(0xE200 + b) for b in range(0x80, 0x100)} | {ord(c): b for c, b in bytes_by(encoding).items()}
    return view | {0xFFFD: 0xFF}


def _utf8(sequence: str) -> str:
    """One sequence given as Latin-1."""
    try:
        return sequence.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return "\ufffd"


@lru_cache(maxsize=None)
def spelt(encoding: str) -> re.Pattern:
    """Well-formed UTF-8 sequences as the encoding spells them; U+FFFD may stand for one of their later bytes."""
    letters: dict[int, list[str]] = {}
    for c, b in bytes_by(encoding).items():
        letters.setdefault(b, []).append(c)
    some = lambda a, z: "[" + "".join(re.escape(c) for b in range(a, z + 1) for c in letters.get(b, [])) + "%s]"
    tail = some(0x80, 0xBF) % "�"
    two, three, four = (some(*x) % "" for x in ((0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4)))
    return re.compile(f"{three}{tail}{{2}}|{four}{tail}{{3}}|{two}{tail}")


_SPELT_BYTES = re.compile("[\xe0-\xef][\x80-\xbf\xff]{2}|[\xf0-\xf4][\x80-\xbf\xff]{3}|[\xc2-\xdf][\x80-\xbf\xff]")


@lru_cache(maxsize=None)
def letter_map(read_as: str, own: str) -> dict[int, str]:
    """For two one-byte encodings: what each character beyond ASCII should have been."""
    out = {}
    for c, b in bytes_by(read_as).items():
        if b >= 0x80:
            try:
                out[ord(c)] = bytes([b]).decode(own)
            except UnicodeDecodeError:
                out[ord(c)] = "�"
    return out


LOST, NONE = -1, -2


@lru_cache(maxsize=1 << 16)
def _bytes_of(c: str, encoding: str) -> list[int]:
    """Bytes of a character by an encoding; U+FFFD stands for one lost byte."""
    if c == "\ufffd":
        return [LOST]
    if encoding not in MANY_BYTES:
        return [bytes_by(encoding).get(c, NONE)]
    try:
        return list(c.encode(encoding))
    except UnicodeEncodeError:
        return [NONE]


@lru_cache(maxsize=1 << 16)
def _decodable(data: tuple[int, ...], own: str, lang: str) -> list[tuple[int, str]]:
    """(number of bytes, characters) that begin the given bytes; lost bytes stand for any that give a letter of the language."""
    out = []
    for size in (1, 2, 3, 4) if own == "utf-8" else (1, 2, 4) if own == "gb18030" else (1, 2, 3) if own == "euc_jp" else (1, 2):
        part = data[:size]
        if len(part) < size or NONE in part or (part[0] == LOST and size == 1):
            continue
        if LOST not in part:
            try:
                c = bytes(part).decode(own)
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                out.append((size, c))
        elif own == "utf-8" and (letters := _spellings(lang).get(size, {}).get(part)):
            out.append((size, letters))
    return out


@lru_cache(maxsize=None)
def _spellings(lang: str) -> dict[int, dict[tuple[int, ...], str]]:
    """By number of bytes: UTF-8 spellings with lost bytes, one known byte at least, and the letters of a language that they may be."""
    known: dict[int, dict[tuple[int, ...], list[str]]] = {}
    letter = re.compile(f"[{LETTERS[lang]}{COMMON}]")
    for code in range(0x80, 0x10000):
        c = chr(code)
        if not letter.match(c):
            continue
        data = c.encode("utf-8")
        for mask in range(1, (1 << len(data)) - 1):
            known.setdefault(len(data), {}).setdefault(tuple(LOST if mask >> k & 1 else b for k, b in enumerate(data)), []).append(c)
    return {size: {k: "".join(v) for k, v in table.items()} for size, table in known.items()}


def _best(ways: list[tuple]) -> list[tuple]:
    """The best ways, one of each context and state."""
    if len(ways) == 1:
        return ways
    top: dict[tuple, tuple] = {}
    for x in ways:
        at = x[1:3]
        if at not in top or (x[0], x[3]) > (top[at][0], top[at][3]):
            top[at] = x
    ranked = sorted(top.values(), key=lambda x: (-x[0], x[3]))
    if len(ranked) <= WAYS:
        return ranked
    # what comes next tells between equals
    return [x for x in ranked[:EQUALS] if x[0] >= ranked[WAYS - 1][0]]


class Channels:
    """Search over channels for the texts of a batch."""

    def __init__(self, table: np.ndarray):
        k = len(ngrams.LANGUAGES)
        self.grams, self.word_counts = table[:k], table[k:]
        self.steps: dict[tuple, float] = {}
        self.viewed: tuple[str, dict] = ("", {})
        total, words = self.grams.sum(axis=1), self.word_counts.sum(axis=1)
        self.usual = (self.grams.astype(np.float64) ** 2).sum(axis=1) / np.maximum(total, 1)
        self.total, self.word_total = total, words
        # what a cell holds by chance: 0 in small corpora, more where the corpus fills all cells
        self.noise, self.word_noise = np.median(self.grams, axis=1), np.median(self.word_counts, axis=1)
        self.span = np.maximum(np.log((self.usual + 0.5) / (self.noise + 0.5)), 0.1)

    def odds(self, cells: np.ndarray, row: int) -> np.ndarray:
        """Log odds of trigrams against chance, 0 where they are no commoner than that; 0 for places that are none."""
        n = np.where(cells >= 0, self.grams[row][np.maximum(cells, 0)], 0)
        return np.maximum(np.log((n + 0.5) / (self.noise[row] + 0.5)), 0.0)

    def bad(self, texts: list[str], row: int) -> list[float]:
        """Unheard-of trigrams of each text: 1 for one that is no commoner than chance, 0 from ``HEARD`` of the usual log odds on."""
        codes, starts = ngrams.codes_of(texts)
        grams = ngrams.trigrams(codes)
        miss = np.where(grams >= 0, np.maximum(1.0 - self.odds(grams, row) / (HEARD * self.span[row]), 0.0), 0.0)
        return np.add.reduceat(miss, starts[:-1]).tolist()

    def strange(self, texts: list[str], row: int) -> list[bool]:
        """Whether each text has a run of rare trigrams, however common the rest of it is."""
        codes, starts = ngrams.codes_of(texts)
        grams = ngrams.trigrams(codes)
        rare = np.concatenate([[0], np.cumsum((grams >= 0) & (codes > 127) & (self.grams[row][np.maximum(grams, 0)] < max(RARE * self.usual[row], 1.5 * self.noise[row])))])
        runs = np.zeros(len(codes), np.int64)
        if len(codes) > RARE_RUN:
            runs[: len(codes) - RARE_RUN + 1] = rare[RARE_RUN:] - rare[:-RARE_RUN] == RARE_RUN
        return (np.add.reduceat(runs, starts[:-1]) > 0).tolist()

    def respelt(self, text: str, lang: str) -> tuple[str, str] | None:
        """As ``search`` for a text in which nothing is odd: the channel that makes its changed parts likeliest, or None."""
        row = ngrams.ROW[lang]
        tries, search, answer = {}, self.decodings(text, lang, False), None
        while True:
            try:
                got = search.send(answer)
            except StopIteration:
                break
            answer = None
            if got is not None:
                tries.setdefault(*got)
        best, most = None, LIKELIER
        old = self.cells(text)
        for got, channel in tries.items():
            new = self.cells(got)
            away, come = np.setdiff1d(old, new), np.setdiff1d(new, old)
            if len(away) >= LEAST_CHANGED and len(come) >= LEAST_CHANGED:
                gain = np.log(self.grams[row][come] + 0.5).mean() - np.log(self.grams[row][away] + 0.5).mean()
                if gain >= most and 3 * len(come) >= len(away):
                    best, most = (got, channel), gain
        return best

    def cells(self, text: str) -> np.ndarray:
        grams = ngrams.trigrams(ngrams.codes_of([text])[0])
        return grams[grams >= 0]

    def word_scores(self, words: list[str], row: int) -> list[float]:
        codes, starts = ngrams.codes_of(words)
        h, at = ngrams.words(codes)
        score = np.full(len(words), UNKNOWN_WORD)
        which = np.searchsorted(starts, at, side="right") - 1
        n = self.word_counts[row][h]
        score[which] = np.where(n > 1.5 * self.word_noise[row], np.log(np.maximum(n, 1) / max(1, self.word_total[row])), UNKNOWN_WORD)
        miss = self.bad(words, row)
        return [s - 1.5 * m if s == UNKNOWN_WORD else s for s, m in zip(score, miss)]

    def tokens(self, text: str, letters: dict[int, str], row: int) -> str:
        """Viterbi over the tokens: each is left or decoded; changing between the two costs."""
        decoded = text.translate(letters)
        spans = [m.span() for m in re.finditer(r"\S+|\s+", text)]
        differ = [text[a:b] != decoded[a:b] for a, b in spans]
        open_ = [i for i, d in enumerate(differ) if d]
        scores = self.word_scores([text[slice(*spans[i])] for i in open_] + [decoded[slice(*spans[i])] for i in open_], row)
        kept, turned = scores[: len(open_)], scores[len(open_) :]
        score, back = [0.0, 0.0], []
        for k, t in zip(kept, turned):
            new, come = [], []
            for state, s in ((0, k), (1, t)):
                stay, change = score[state], score[1 - state] - SWITCH
                new.append(max(stay, change) + s)
                come.append(state if stay >= change else 1 - state)
            score = new
            back.append(come)
        state, path = int(score[1] > score[0]), []
        for come in reversed(back):
            path.append(state)
            state = come[state]
        turn = {i for i, s in zip(open_, reversed(path)) if s}
        return "".join((decoded if i in turn else text)[a:b] for i, (a, b) in enumerate(spans))

    def lattice(self, text: str, read_as: str, own: str, row: int) -> str | None:
        """The likeliest mixture of kept and decoded characters; None where nothing can be decoded. Each damaged span is a
        lattice over its bytes with wildcards for lost ones; Viterbi search goes by the trigrams, and the words that the best
        ways give are told by their frequencies."""
        out, done = [], 0
        for m in (_HIGH if own == "utf-8" else _HIGH_TRAILED).finditer(text):
            if m.start() < done:
                continue
            out.append(text[done : m.start()])
            before = "".join(out[-2:])[-2:]
            out.append(self.span_of(m.group(), before, text[m.end() : m.end() + 1], read_as, own, row))
            done = m.end()
        got = "".join(out) + text[done:]
        return got if got != text else None

    def span_of(self, span: str, before: str, after: str, read_as: str, own: str, row: int) -> str:
        data: list[int] = []  # a byte, LOST, or NONE where the character has none
        begins: dict[int, str] = {}
        for c in span:
            begins[len(data)] = c
            data += _bytes_of(c, read_as)
        n = len(data)
        if own == "utf-8" and min(data) >= 0:
            try:
                return bytes(data).decode("utf-8")  # every sequence is whole: one way only has no bytes left over
            except UnicodeDecodeError:
                pass
        ways: list[list[tuple]] = [[] for _ in range(n + 1)]
        ways[0] = [(0.0, ("  " + before)[-2:], False, "")]
        for i in range(n):
            if not ways[i]:
                continue
            best = ways[i] = _best(ways[i])
            c = begins.get(i)
            if c is not None:
                j = i + len(_bytes_of(c, read_as))
                ways[j] += [(s + self.step(w, c, row) - (SWITCH if turned else 0.0), (w + c)[-2:], False, t + c) for s, w, turned, t in best]
            for size, letters in _decodable(tuple(data[i : i + 4]), own, ngrams.LANGUAGES[row]):
                if c is not None and c < "\x80" and size == 1:
                    continue  # kept above
                sure = len(letters) == 1
                for s, w, turned, t in best:
                    s -= 0.0 if turned or not t else SWITCH
                    found = [(s + self.step(w, x, row) + (WELL_FORMED * (size - 1) if sure else 0.0), (w + x)[-2:], True, t + x) for x in letters]
                    ways[i + size] += _best(found) if not sure else found
        if not ways[n]:
            return span
        ends = _best(ways[n])
        if after:
            ends = [(s + self.step(w, after, row), w, turned, t) for s, w, turned, t in ends]
        top = max(x[0] for x in ends)
        ends = [x for x in ends if x[0] > top + 0.5 * UNKNOWN_WORD]
        if len(ends) > 1:  # the words decide among the best ways
            known = self.word_scores([(before.rpartition(" ")[2] + t) or " " for _, _, _, t in ends], row)
            ends = [(s + 0.5 * (k - UNKNOWN_WORD) * (k > UNKNOWN_WORD), *rest) for (s, *rest), k in zip(ends, known)]
        return max(ends, key=lambda x: (x[0], x[3]))[3]

    def step(self, before: str, c: str, row: int) -> float:
        """Log odds of a character after two others."""
        at = (row, before, c)
        got = self.steps.get(at)
        if got is None:
            if len(self.steps) > 500_000:
                self.steps.clear()
            n = self.grams[row, ngrams.trigram_of((before + c).lower())]
            got = self.steps[at] = max(math.log((n + 0.5) / (self.noise[row] + 0.5)), 0.0)
        return got

    def straight(self, text: str, read_as: str, own: str) -> str | None:
        """The text with every whole sequence decoded, lost bytes left lost: a cheap view by which channels are ranked."""
        if own == "utf-8" and read_as not in MANY_BYTES:
            pattern = spelt(read_as)
            return pattern.sub(lambda m: _utf8(m.group().translate(byte_view(read_as))), text) if pattern.search(text) else None
        if read_as in MANY_BYTES:
            seen = b"\xff".join(p.encode(read_as, "replace") for p in text.split("\ufffd"))
        else:
            seen = text.translate(byte_view(read_as)).encode("latin-1", "replace")
        if own == "utf-8":
            view = seen.decode("latin-1")
            return _SPELT_BYTES.sub(lambda m: _utf8(m.group()), view) if _SPELT_BYTES.search(view) else None
        return seen.decode(own, "replace")

    def likely(self, text: str, channels: list[tuple[str, str]], row: int) -> list[tuple[str, str]]:
        """The channels whose cheap view is heard of most, ties included."""
        if self.viewed[0] != text:  # the views of a text are the same for every language
            self.viewed = (text, {})
        seen = self.viewed[1]
        for c in channels:
            if c not in seen:
                seen[c] = self.straight(text, *c)
        views = [(seen[c], c) for c in channels if seen[c] is not None and seen[c] != text]
        views = list({got: (got, c) for got, c in reversed(views)}.values())[::-1]  # equal views: the first channel
        views += [(again, c) for got, c in views if c[1] == "utf-8" for x in TWICE if (again := self.straight(got, x, "utf-8")) is not None]
        if not views:
            return []
        misses = self.bad([got for got, _ in views], row)
        least = min(misses)
        return list(dict.fromkeys(c for m, (_, c) in zip(misses, views) if m <= least + NEAR))

    def decodings(self, text: str, lang: str, only_utf8: bool):
        """(decoded text, channel) by each channel that the text's odd characters allow."""
        row = ngrams.ROW[lang]
        odd = ODD[lang].findall(text)
        wide = bool(_WIDE.search(text))
        for read_as, own in self.likely(text, [(x, "utf-8") for x in READ_AS if x not in MANY_BYTES or wide], row):
            got = self.lattice(text, read_as, own, row)
            if got is not None:
                yield got, f"utf-8 read as {read_as}"
                for again_as in TWICE:
                    if spelt(again_as).search(got) and (again := self.lattice(got, again_as, "utf-8", row)) is not None:
                        yield again, f"utf-8 read as {read_as}, twice"
        if only_utf8 or (yield None):
            return
        high, several = sum(c > "\x7f" for c in text), []
        for own in OWN_AS[lang]:
            if own == "utf-8":
                continue
            for read_as in READ_AS:
                if read_as == own or (read_as in MANY_BYTES and not wide):
                    continue
                if own not in MANY_BYTES:
                    if read_as in MANY_BYTES:
                        continue
                    letters = letter_map(read_as, own)
                    if odd:
                        turned = [letters.get(ord(c), c) for c in odd]
                        if sum(t == c or bool(ODD[lang].match(t)) for t, c in zip(turned, odd)) > len(odd) // 4:
                            continue
                    got = self.tokens(text, letters, row)
                else:
                    if read_as in MANY_BYTES or 4 * sum(_bytes_of(c, read_as)[0] < 0 for c in text if "\x7f" < c <= "\xff") <= high:
                        several.append((read_as, own))
                    continue
                if got != text:
                    yield got, f"{own} read as {read_as}"
        for read_as, own in self.likely(text, several, row):
            got = self.lattice(text, read_as, own, row)
            if got is not None and got.count("\ufffd") <= max(1, len(got) // 10):
                yield got, f"{own} read as {read_as}"

    def search(self, text: str, lang: str | None) -> tuple[str, str] | None:
        """(restored text, channel) of the best channel, or None if no channel makes sense of the text."""
        best, best_worth = None, 0.0
        for name in [lang] if lang in ngrams.ROW else ngrams.LANGUAGES:
            row = ngrams.ROW[name]
            if not self.total[row]:
                continue
            first, tries = self.bad([text], row)[0], []
            search, answer, done = self.decodings(text, name, lang not in ngrams.ROW), None, 0
            while True:
                try:
                    got = search.send(answer)
                except StopIteration:
                    break
                answer = None
                if got is None:  # the UTF-8 channels are through; the others are needless if one of these is perfect
                    misses = self.bad([t for t, _ in tries], row) if tries else []
                    answer = bool(misses) and min(misses) <= 0.2 * first - 0.2
                elif got not in tries:
                    tries.append(got)
            if not tries:
                continue
            for (got, channel), m in zip(tries, self.bad([t for t, _ in tries], row)):
                changed = sum(c > "\x7f" for c in text) - sum(c > "\x7f" and c in text for c in got)
                gain = first - m
                fine = gain >= max(LEAST_GAIN, GAIN_SHARE * min(changed, first)) and m <= LEFT_SHARE * first + 1
                if fine and (changed < 4 or first < 3) or (not fine and gain >= 1 and changed < 6):
                    fine = self.knows(text, got, row)
                worth = gain - 0.01 * len(got) * (gain > 2) - (0.5 if "twice" in channel else 0) - 0.5 * got.count("�")
                if fine and worth > best_worth:
                    best, best_worth = (got, channel), worth
        return best

    def knows(self, text: str, got: str, row: int) -> bool:
        """Whether the changed words, of three characters at least, are far likelier words of the corpus than before."""
        if ngrams.LANGUAGES[row] in UNSPACED:
            return False
        before, after = text.split(), got.split()
        new = [w for w in set(after) - set(before) if len(w) >= 3]
        old = [w for w in set(before) - set(after) if len(w) >= 3]
        if not new or not old:
            return False
        scores = self.word_scores(new + old, row)
        likely = sum(scores[: len(new)]) / len(new)
        return likely > UNKNOWN_WORD + 2 and likely >= sum(scores[len(new) :]) / len(old) + 4

    def fill(self, text: str, lang: str | None) -> str:
        """Question marks within words of Latin script replaced by the letters that the corpus likes there."""
        if lang not in LETTERS or lang in OWN:
            return text
        row, letters = ngrams.ROW[lang], [c for c in LETTERS[lang] if c.isalpha()]

        def best(m: re.Match) -> str:
            if len(m.group()) > 1:
                return m.group()
            a, b = m.string[max(0, m.start() - 2) : m.start()], m.string[m.end() : m.end() + 2]
            misses = self.bad([a + x + b for x in letters], row)
            return letters[int(np.argmin(misses))] if min(misses) < 0.5 else "?"

        return _LOST_INSIDE.sub(best, text)


def lost(text: str, lang: str | None) -> bool:
    """Question marks where letters must have been."""
    if "?" not in text:
        return False
    bare = _ADDRESS.sub(" ", text)
    inside, runs, lead = len(_LOST_INSIDE.findall(bare)), sum(map(len, _LOST_RUN.findall(bare))), len(_LOST_LEAD.findall(bare))
    if lang in OWN:
        return runs >= 3 or (bare.count("?") >= 3 and inside + lead + runs >= 2)
    return inside + lead > 0 or runs >= 4


def suspicious(text: str, lang: str | None) -> bool:
    return bool(CERTAIN.search(text)) or (not text.isascii() and bool(ODD.get(lang, ODD[None]).search(text))) or lost(text, lang)


def sound(lang: str, text: str) -> bool:
    """Texts that frequencies are learned from."""
    return not suspicious(text, lang)


def learn(texts: DataFrame) -> np.ndarray:
    """Trigram and word counts of all sound texts of ``lang, text``."""
    return ngrams.table_of(ngrams.counts(texts, sound, with_words=True), with_words=True)


def judged(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """``id, restored, channel`` of the garbled texts among ``id, lang, text``; channel is 'lost' where nothing can be restored."""
    shared = texts.sparkSession.sparkContext.broadcast(table)  # fixed size

    def run(batches):
        channels = Channels(shared.value)
        known: dict[tuple, tuple | None] = {}  # answers for distinct texts
        for batch in batches:
            keys, langs, values = (c.to_pylist() for c in batch.columns)
            rows = []
            doubtful: dict[str, list[int]] = {}
            if len(known) > KNOWN:
                known.clear()
            for i, (key, lang, text) in enumerate(zip(keys, langs, values)):
                if not text:
                    continue
                if text.isascii():
                    if lost(text, lang):
                        rows.append((key, channels.fill(text, lang), "lost"))
                elif suspicious(text, lang):
                    at = (lang, text)
                    if at not in known:
                        got = channels.search(text, lang)
                        if got is None and (CERTAIN.search(text) or lost(text, lang)):
                            got = (channels.fill(text, lang), "lost")
                        known[at] = got
                    if known[at]:
                        rows.append((key, *known[at]))
                elif lang in OWN and channels.total[ngrams.ROW[lang]]:
                    doubtful.setdefault(lang, []).append(i)
            for lang, at in doubtful.items():
                chosen = [values[i] for i in at]
                for i, looked_at in zip(at, channels.strange(chosen, ngrams.ROW[lang])):
                    if looked_at:
                        text = values[i]
                        if (lang, text) not in known:
                            known[lang, text] = channels.respelt(text, lang)
                        if known[lang, text]:
                            rows.append((keys[i], *known[lang, text]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["id", "restored", "channel"])

    return texts.select("id", "lang", "text").mapInArrow(run, "id bigint, restored string, channel string")


def restored(units: DataFrame, files: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """``unit_key, restored, channel`` of every unit whose source is wholly or partly garbled."""
    langs = files.select(F.col("file_id").cast("bigint"), ngrams.primary(F.col("source_language")).alias("lang")).groupBy("file_id").agg(F.min("lang").alias("lang"))
    slim = units.select(F.col("unit_key").cast("bigint").alias("id"), F.col("file_id").cast("bigint"), F.col("source").alias("text")).where("text is not null and text <> ''")
    texts = skew_join(slim, langs, ["file_id"], F.col("id"), how="left").select("id", "lang", "text")
    table = learn(texts) if table is None else table
    return judged(texts, table).groupBy(F.col("id").alias("unit_key")).agg(F.min(F.struct("restored", "channel")).alias("r")).select("unit_key", "r.restored", "r.channel")


def found(units: DataFrame, files: DataFrame) -> DataFrame:
    """``unit_key`` of every garbled unit."""
    return restored(units, files).select("unit_key")
