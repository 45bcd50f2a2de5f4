"""Defective prompt and response pairs.

Responses are sorted by text within their language; where a response is the beginning of its neighbour, it may be a
shortened version of it. Lengths at which unfinished responses pile up are length limits. Copies, refusals and foreign
languages are told by rules whose evidence comes from the corpus: how often a source is translated at all, how many
unlike sources one response answers, and trigram models of the languages.

The first that fits counts: empty, refusal, copy, wrong_language, truncated.

Defined results: a null or blank response is empty; so is a mere sign for nothing, unless the source is one too. A null
or blank prompt can't be copied. Without both language tags a pair can't be a copy or in a wrong language. Re-sent
units count once. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.io import materialise, skew_join
from segforge.llm import ngrams

# Signs for "nothing here", besides strings without any letter or digit.
NOTHING = re.compile(r"(?i)\W*(?:n\W?/?\W?a|none|null|nil|empty|undefined|nan|no (?:translation|target|text)|not (?:available|translated)|<\W*target\W*>|missing|todo|tbd)\W*")
# Ways of declining, by language; they name both the inability and the task or the translator.
REFUSALS = [
    r"\b(?:can(?:no|')t|can’t|cannot|can not|unable to|not able to|won['’]t be able to|won['’]t|will not|do(?:n['’]t| not)|am not|not comfortable|refuse to|decline to|must decline)\b[^.!?。！？।]{0,60}\b(?:translat\w*|assist\w*|help\w*|comply|fulfil+|request|provide|process|this (?:text|content|passage|segment|material))",
    r"\bunable to comply\b|\b(?:goes |is )?against (?:my|our|the) (?:guideline|polic|rule)|\bcontent polic|\bhas been (?:declined|refused|rejected) by\b|\b(?:request|translation) (?:was|is|has been) (?:declined|refused|denied)|\bno translation can be\b|\bas an? (?:ai|language|translation|virtual)\b[^.!?。！？।]{0,40}\b(?:model|assistant|system)",
    r"\bich (?:kann|darf|werde|möchte)\b[^.!?。！？।]{0,60}\b(?:nicht|leider|kein\w*)\b[^.!?。！？।]{0,60}(?:übersetz|helf|hilf|anfrage|bearbeit|behilflich|unterstütz|erfüll|nachkomm)|\b(?:kann|darf) ich\b[^.!?。！？।]{0,60}\b(?:nicht|kein\w*)\b[^.!?。！？।]{0,40}(?:übersetz|helf|behilflich|unterstütz|bearbeit|erfüll)|\b(?:anfrage|übersetzung)\b[^.!?。！？।]{0,30}\b(?:abgelehnt|verweigert)|\babgelehnt\b[^.!?。！？।]{0,40}(?:anfrage|übersetz)|(?:lehne|verweigere)\b[^.!?。！？।]{0,60}(?:anfrage|übersetz|\bab\b)|(?:nicht|außerstande|keine?)[^.!?。！？।]{0,30}(?:übersetzung (?:an|liefern|bereit)|übersetzen (?:kann|darf))",
    r"\bje (?:ne (?:peux|puis|suis|vais|saurais|souhaite)|refuse|regrette|suis dans l)\b[^.!?。！？।]{0,80}(?:tradui|aid|assist|demande|répondre|texte|contenu|accéder)|\b(?:demande|traduction)\b[^.!?。！？।]{0,40}(?:refusée|rejetée|impossible|déclinée)|(?:impossible|pas possible) (?:pour moi )?de traduire|(?:tradui|traduction)[^.!?。！？।]{0,20}(?:m['’]est|nous est) impossible",
    r"\bno (?:puedo|podemos|podré|me es posible|estoy en condiciones|me está permitido|estoy autorizad\w)\b[^.!?。！？।]{0,60}(?:traduc|traduzc|ayud|asist|solicitud|petición|contenido|proporcion|atender)|\b(?:solicitud|petición|traducción)\b[^.!?。！？।]{0,30}(?:rechazad|denegad|declinad)|\b(?:me niego|rechazo|declino)\b[^.!?。！？।]{0,40}(?:traduc|solicitud|petición)",
    r"\bnão (?:posso|podemos|consigo|poderei|me é possível|estou autorizad\w|sou capaz)\b[^.!?。！？।]{0,60}(?:tradu|ajud|auxili|solicita|pedido|conteúdo|atender|fornec)|\b(?:solicitação|pedido|tradução)\b[^.!?。！？।]{0,30}(?:recusad|negad|rejeitad)|\b(?:recuso|declino)\b[^.!?。！？।]{0,40}(?:tradu|pedido|solicita)",
    r"\bnie (?:mogę|możemy|jestem w stanie|potrafię|będę|wolno mi|mam możliwości)\b[^.!?。！？।]{0,60}(?:tłumacz|pomóc|pomagać|prośb|żądani|zrealizow|treś|spełni)|\b(?:odmawiam|odmowa)\b|\b(?:prośba|żądanie)\b[^.!?。！？।]{0,30}odrzucon",
    r"(?:\bя )?\bне (?:могу|можем|смогу|в состоянии|имею права|буду|готов)\b[^.!?。！？।]{0,60}(?:перев|помо|запрос|просьб|выполн|обработ|ответить)|\b(?:отказываюсь|вынужден\w* отказать)|\b(?:запрос|перевод)\b[^.!?。！？।]{0,30}(?:отклон|невозможен)",
    r"(?:翻訳|お手伝い|ご依頼|ご要望|リクエスト|お応え|対応|お答え|ご協力|支援)[^.!?。！？।]{0,24}(?:できません|できかねます|いたしかねます|しかねます|お断り|出来ません|応じられません|不可能)|(?:翻訳|依頼|リクエスト)[^.!?。！？।]{0,10}(?:拒否|辞退)",
    r"(?:不能|无法|不会|不可以|没法|拒绝|难以|不便)[^.!?。！？।]{0,16}(?:翻译|协助|帮助|帮您|帮你|请求|处理这个|提供译文|完成|满足|回答)|(?:请求|翻译)[^.!?。！？।]{0,8}(?:被拒绝|已拒绝|遭到拒绝)",
    r"(?:ไม\u0e48สามารถ|ไม\u0e48อาจ|ขอปฏ\u0e34เสธ|ปฏ\u0e34เสธท\u0e35\u0e48จะ|ไม\u0e48ขอ)[^.!?。！？।]{0,40}(?:แปล|ช\u0e48วย|คำขอ|ดำเน\u0e34นการ|ให\u0e49บร\u0e34การ)|(?:ช\u0e48วย|แปล|คำขอ|ตอบ)[^.!?。！？।]{0,40}(?:ไม\u0e48ได\u0e49|ถ\u0e39กปฏ\u0e34เสธ)$",
    r"(?:لا (?:أستطيع|يمكنني|يمكننا|أقدر|نستطيع|أتمكن)|لن (?:أتمكن|أستطيع|أقوم)|لست قادر|غير قادر|ليس بإمكاني|يتعذر علي|تعذر علي|لا يسعني)[^.!?。！？।]{0,60}(?:ترجم|مساعد|المساعدة|طلب|تنفيذ|النص|المحتوى)|(?:أرفض|أعتذر عن)[^.!?。！？।]{0,40}|(?:تم رفض|ر\u064fفض|رفض) [^.!?。！？।]{0,20}(?:طلب|الترجمة)",
    r"(?:अन\u0941वाद|सहायता|मदद|अन\u0941रोध)[^.!?。！？।]{0,50}(?:नही\u0902 (?:कर|द\u0947|हो|किया|प\u0942रा|सक)|असमर\u094dथ|अस\u094dवीकार|मना)|म\u0948\u0902 [^.!?。！？।]{0,60}(?:असमर\u094dथ|इनकार|मना) ",
]
REFUSES = re.compile("|".join(f"(?:{x})" for x in REFUSALS), re.I)
# Stems of which each way of declining above holds at least one.
STEMS_LATIN = "translat assist help comply request provide process this fulfil guideline polic rule declin refus rejec denied an ai übersetz helf hilf anfrage bearbeit behilflich unterstütz erfüll nachkomm verweiger lehne trad aid demande répondre texte contenu accéder ayud asist solicitud petición contenido proporcion atender rechaz niego ajud auxili solicit pedido conteúdo fornec recus tłumacz pomóc pomagać prośb żądani zrealizow treś spełni odmawiam odmowa".split()
STEMS_OTHER = "перев помо запрос просьб выполн обработ ответить отказ 翻訳 手伝 依頼 要望 リクエスト お応え 対応 お答え 協力 支援 翻译 协助 帮 请求 处理 提供 完成 满足 回答 แปล ช\u0e48วย คำขอ ดำเน\u0e34นการ ให\u0e49บร\u0e34การ ปฏ\u0e34เสธ ترجم مساعد طلب تنفيذ النص المحتوى أرفض أعتذر अन\u0941वाद सहायता मदद अन\u0941रोध असमर\u094dथ इनकार मना".split()
# Ends of sentences, closing marks and ellipses.
TERMINAL = ".!?:;。！？．：；｡।॥؟۔…"
CLOSING = "\"'”“»«’‘)]}）］｝」』】〉》>*_ \t\r\n\xa0\u200b\u200e\u200f\u2060\ufeff\u202f"
ELLIPSIS = re.compile(r"(?:\.\.\.+|…+|。。。+)$")
#: Languages that end sentences without a mark.
UNMARKED = {"th"}
UNSPACED = re.compile("[\u0e00-\u0effက-႟ក-\u17ff⺀-\u2fdf々-〇\u3040-ヿ㐀-鿿豈-\ufaff]")
_NOT_WORD = re.compile(r"[\W_]+")
_TAIL = re.compile(r"\s*(?:[#(\[]\s*)?(?:id|ref|no|nr)?\.?\s*\d+\s*[)\]]?$", re.I)
_QUOTED = re.compile("[«“„「『\"‘][^»”“」』\"’]{0,60}[»”“」』\"’]")
_QUOTE = re.compile("[«“„「『\"‘]")
_LABEL = re.compile(r"^[^\W\d_]{1,14}\s?[:：]\s*")
_DIGITS = re.compile(r"\d+")
_LATIN = re.compile(r"[A-Za-z0-9_.\-]+")
_NAMES = re.compile(r"\S*\d\S*|(?<=\W)[A-ZÀ-ÖØ-ÞĄĆĘŁŃŒŚŸŹŻ]\w*")
_MASKED = re.compile(r"w(?:\W w)+(?!\w)|w(?: w)+(?!\w)")
_CODE = re.compile(r"<[^>]*>|\{[^}]*\}|%\S+|https?://\S+|\S+@\S+|\b[\w\-]+\.[A-Za-z]{1,10}\b|\S*\d\S*")
_SMALL_WORD = re.compile(r"(?<!\w)[^\W\d_]*[a-zà-öø-ÿāăąćčďđēėęěğģīįıķļłńņňōőœřśşšţťūůűųźżž][^\W\d_]*", re.U)
_OWN_SCRIPT = re.compile("[Ѐ-ӿ\u0600-ۿ\u0900-ॿ\u0e00-\u0e7f\u3040-ヿ㐀-鿿]")
#: Evidence of a foreign language: log odds in all, and trigrams at least.
MARGIN, LEAST_TRIGRAMS = 8.0, 4
#: A response is canned from so many occurrences, with so large a share of unlike sources and so many for each language.
CANNED_LEAST, CANNED_SHARE, CANNED_PER_LANGUAGE = 8, 0.25, 2.0
#: A length is a limit where so many times more unfinished responses end than at the lengths around it, and so many at least.
SPIKE_TIMES, SPIKE_LEAST = 4.0, 8
#: A text is a cut one if its units are at most such a share of those of the longer responses that go on from it; at a length
#: limit, where none is known, of those that end there.
CUT_SHARE, PILE_SHARE = 1.0, 0.25
#: Share of responses with a mark from which a language has the habit.
HABIT = 0.8


def key_of(text: str) -> str:
    """Letters and digits, case folded."""
    return _NOT_WORD.sub("", text.casefold())


def skeleton(text: str) -> str:
    """The text without trailing number, with digits and quotations masked."""
    bare = _QUOTED.sub("Q", text.strip()) if _QUOTE.search(text) else text.strip()
    if bare[-1:] in "0123456789)]":
        bare = _TAIL.sub("", bare)
    return _DIGITS.sub("0", bare)


def source_skeleton(text: str) -> str:
    return _LATIN.sub("w", _QUOTED.sub("Q", text))


def masked(text: str, lang: str | None) -> str:
    """For sorting: names and what holds digits masked; in scripts other than Latin all Latin words are."""
    bare = text.strip()
    return _MASKED.sub("w", _LATIN.sub("w", bare) if _OWN_SCRIPT.search(bare) else _NAMES.sub("w", bare))


def refuses(text: str) -> bool:
    low = text.lower()
    stems = STEMS_OTHER if _OWN_SCRIPT.search(low) else STEMS_LATIN
    return any(x in low for x in stems) and bool(REFUSES.search(_CODE.sub(" ", text)))


def is_nothing(source: str | None, target: str | None) -> bool:
    if target is None or not target.strip():
        return True
    if not key_of(target):
        return bool(source and key_of(source))
    return bool(NOTHING.fullmatch(target)) and key_of(source or "") != key_of(target)


def is_copy(source: str, target: str) -> bool:
    """The source again, perhaps with other case, marks or space, framed, labelled or repeated."""
    a, b = key_of(source), key_of(target)
    if not a or not b:
        return False
    if a == b:
        return True
    if a not in b:
        return False
    rest = b.replace(a, "")
    return not rest or (len(a) >= 15 and len(rest) <= len(a) // 5) or (rest == b[: len(rest)] and key_of(_LABEL.sub("", target.strip())) == a)


def plainly_words(text: str) -> bool:
    """Certainly has words to translate: letters of an own script, or two words with small letters besides names and code."""
    bare = _CODE.sub(" ", text)
    if _OWN_SCRIPT.search(bare):
        return True
    words = _SMALL_WORD.findall(bare)
    return sum(w[0].islower() for w in words) >= 2 or len(words) >= 5


def ends(text: str) -> bool:
    bare = text.rstrip(CLOSING)
    return bool(bare) and bare[-1] in TERMINAL


def finished(text: str) -> bool:
    """Ends like a sentence, perhaps before a number at the very end."""
    return ends(text) or (text.rstrip()[-1:] in "0123456789)]" and ends(_TAIL.sub("", text.rstrip())))


def habit_of(lang: str | None, text: str) -> str:
    """Whose habits a text may have: its language's or, without one, those of its first letter's block."""
    return lang or f"{next((ord(c) >> 8 for c in text if c.isalpha()), 0):x}"


def sentence_like(text: str | None) -> bool:
    """Ends like a sentence or, in unmarked languages, is too long for a title."""
    if not text:
        return False
    return ends(text) or (bool(re.search("[\u0e00-\u0e7f]", text)) and len(text.strip()) >= 20)


class Judge:
    """Rules that need nothing but the pair and the language models."""

    def __init__(self, table: np.ndarray):
        self.model = ngrams.log_probabilities(table)
        self.trained = table.sum(axis=1) > 0

    def foreign(self, targets: list[str], langs: list[str | None]) -> list[bool]:
        sums, n = ngrams.scores(targets, self.model)
        sums = np.where(self.trained, sums, -np.inf)
        out = []
        for i, lang in enumerate(langs):
            row = ngrams.ROW.get(lang)
            out.append(row is not None and bool(self.trained[row]) and n[i] >= LEAST_TRIGRAMS and float(sums[i].max() - sums[i][row]) > MARGIN)
        return out

    def judge(self, sources: list, targets: list, sl: list, tl: list) -> Iterator[tuple[str | None, str | None, str | None]]:
        """(defect, kind of doubt, key of the evidence that settles the doubt) of each pair; doubts: copy, cut, or none but
        whether the response is canned."""
        foreign = self.foreign([_CODE.sub(" ", t) if t else "" for t in targets], tl)
        for s, t, a, b, other in zip(sources, targets, sl, tl, foreign):
            if is_nothing(s, t):
                yield "empty", None, None
            elif refuses(t) and not (s and refuses(s)):
                yield "refusal", None, None
            else:
                both = bool(a and b)
                if both and a != b and s and is_copy(s, t):
                    yield ("copy", None, None) if plainly_words(s) else (None, "copy", key_of(s))
                elif both and other and len(key_of(_CODE.sub("", t))) >= 4 and key_of(s or "") != key_of(t):
                    yield "wrong_language", "canned", None
                elif s and ELLIPSIS.search(t.rstrip()) and not ELLIPSIS.search(s.rstrip()) and sentence_like(s):
                    yield "truncated", "canned", None
                elif sentence_like(s) and not finished(t):
                    yield None, "cut", masked(t, b)
                else:
                    yield None, "canned", None


def tagged(units: DataFrame, files: DataFrame) -> DataFrame:
    """Approved pairs with the primary subtags of their file's languages."""
    pairs = units.where("approved = 'yes'").select(F.col("unit_key").cast("bigint"), F.col("file_id").cast("bigint"), "source", "target")
    langs = files.select(F.col("file_id").cast("bigint"), ngrams.primary(F.col("source_language")).alias("sl"), ngrams.primary(F.col("target_language")).alias("tl")).groupBy("file_id").agg(F.min("sl").alias("sl"), F.min("tl").alias("tl"))
    return skew_join(pairs, langs, ["file_id"], F.col("unit_key"), how="left").select("unit_key", "sl", "tl", "source", "target")


def model_of(units: DataFrame, files: DataFrame) -> np.ndarray:
    """Trigram counts of all sources under their file's language."""
    langs = files.select(F.col("file_id").cast("bigint"), ngrams.primary(F.col("source_language")).alias("lang")).where("lang is not null").groupBy("file_id").agg(F.min("lang").alias("lang"))
    texts = skew_join(units.select(F.col("file_id").cast("bigint"), F.col("unit_key"), F.col("source").alias("text")).where("text is not null"), langs, ["file_id"], F.col("unit_key"))
    return ngrams.table_of(ngrams.counts(texts))


JUDGED = "unit_key bigint, tl string, defect string, doubt string, h bigint, shape string, response bigint, source_shape bigint, sl string, chars int, unfinished boolean, skey bigint, differs boolean, closed boolean, habit string"


def judged(pairs: DataFrame, table: np.ndarray) -> DataFrame:
    """Every pair with its certain defect or its doubt."""
    shared = pairs.sparkSession.sparkContext.broadcast(table)  # languages times buckets at most

    def run(batches):
        import xxhash

        h = lambda x: np.int64(np.uint64(xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace"))).astype(np.int64))
        judge = Judge(shared.value)
        for batch in batches:
            keys, sl, tl, sources, targets = (c.to_pylist() for c in batch.columns)
            rows = list(judge.judge(sources, targets, sl, tl))
            shapes = [k if d == "cut" else None for _, d, k in rows]
            titles = [key_of(s) if s and a != b and d not in ("empty", "refusal") else None for s, a, b, (d, _, _) in zip(sources, sl, tl, rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()), pa.array(tl, pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                    pa.array([None if k is None else int(h(k)) for _, _, k in rows], pa.int64()),
                    pa.array([s if s is not None else masked(t, b) if t and ends(t) or b in UNMARKED and t else None for s, t, b in zip(shapes, targets, tl)], pa.string()),
                    pa.array([int(h(skeleton(t))) if t and d in ("canned", "cut") else None for t, (_, d, _) in zip(targets, rows)], pa.int64()),
                    pa.array([int(h(source_skeleton(s))) if s and d in ("canned", "cut") else None for s, (_, d, _) in zip(sources, rows)], pa.int64()),
                    pa.array(sl, pa.string()), pa.array([len(t) if t else 0 for t in targets], pa.int32()),
                    pa.array([bool(t) and not finished(t) for t in targets], pa.bool_()),
                    pa.array([int(h(k)) if k else None for k in titles], pa.int64()),
                    pa.array([bool(k and t) and k != key_of(t) for k, t in zip(titles, targets)], pa.bool_()),
                    pa.array([bool(s) and ends(s) for s in sources], pa.bool_()),
                    pa.array([habit_of(b, t) if t else None for t, b in zip(targets, tl)], pa.string()),
                ],
                names=[c.split()[0] for c in JUDGED.split(", ")],
            )

    return pairs.mapInArrow(run, JUDGED)


def shortened(shapes: DataFrame) -> DataFrame:
    """``tl, shape, inside, longer`` of responses that begin their neighbour in the sorted order of ``tl, shape``.

    If any other response begins with a text, its next neighbour does. Tasks hold ranges of the order; a table with one row
    a range, and one for each text that may begin rows beyond it, carries on what a range leaves open. ``inside``: the
    neighbour goes on within a word. ``longer``: units (``n`` of the input, else 1 a row) of all longer responses.
    """

    def run(batches):
        pid, before, first = TaskContext.get().partitionId(), None, None
        open_: list[list] = []  # texts that begin the row at hand: shape, inside, longer
        steps: dict[int, int] = {}  # units of the leading rows by the length that they share with the first
        shared = 0
        out: list[tuple] = []
        for batch in batches:
            for tl, shape, n in zip(*(c.to_pylist() for c in batch.columns)):
                if first is None:
                    first, shared = (tl, shape), len(shape)
                if tl != first[0]:
                    shared = 0
                elif shared:
                    shared = min(shared, len(os.path.commonprefix([first[1], shape])))
                if shared:
                    steps[shared] = steps.get(shared, 0) + n
                while open_ and (before != tl or not shape.startswith(open_[-1][0])):
                    out.extend(_closed(open_.pop(), pid, before))
                if open_ and open_[-1][1] is None:
                    open_[-1][1] = _goes_on_inside(shape, len(open_[-1][0]))
                for x in open_:
                    x[2] += n
                open_.append([shape, None, 0])
                before = tl
            yield _rows(out)
            out = []
        if first is not None:
            for x in open_:
                out.extend(_closed(x, pid, before))
            out += [("open", pid, before, x[0], None, 0, None, None) for x in open_]
            out.append(("first", pid, *first, None, 0, list(steps), list(steps.values())))
            yield _rows(out)

    counted = shapes if "n" in shapes.columns else shapes.withColumn("n", F.lit(1))
    ordered = counted.select("tl", "shape", F.col("n").cast("bigint").alias("n")).repartitionByRange("tl", "shape").sortWithinPartitions("tl", "shape")
    found = materialise(ordered.mapInArrow(run, SHORTENED))
    opens = found.where("kind = 'open'").select("pid", "tl", "shape")
    firsts = found.where("kind = 'first'").select(F.col("pid").alias("pid2"), F.col("tl").alias("tl2"), F.col("shape").alias("shape2"), "lengths", "units")
    met = opens.join(firsts, F.expr("tl = tl2 and pid2 > pid and startswith(shape2, shape) and shape2 <> shape"))
    more = F.expr("aggregate(zip_with(lengths, units, (l, u) -> if(l >= length(shape), u, 0L)), 0L, (a, x) -> a + x)")
    inside = F.expr(f"substring(shape2, length(shape) + 1, 1) RLIKE '{INSIDE}'")
    beyond = met.groupBy("tl", "shape").agg(F.min_by(inside, "pid2").alias("inside"), F.sum(more).alias("longer"))
    return found.where("kind = 'short'").select("tl", "shape", "inside", "longer").unionByName(beyond).groupBy("tl", "shape").agg(F.max("inside").alias("inside"), F.sum("longer").alias("longer"))


SHORTENED = "kind string, pid int, tl string, shape string, inside boolean, longer bigint, lengths array<int>, units array<bigint>"
#: Letters, digits and Thai marks that go on within a word.
INSIDE = "[\\p{L}\\p{N}_\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]"


def _goes_on_inside(shape: str, at: int) -> bool:
    return bool(re.match(r"\w|[\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]", shape[at]))


def _closed(text: list, pid: int, tl: str) -> list[tuple]:
    return [("short", pid, tl, *text, None, None)] if text[2] else []


def _rows(found: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names=[c.split()[0] for c in SHORTENED.split(", ")])


def limits(marked: DataFrame) -> DataFrame:
    """``chars, pile`` of lengths at which unfinished responses pile up. One row a length."""
    n = marked.where("doubt = 'cut' or (unfinished and defect = 'truncated')").groupBy("chars").agg(F.count("*").alias("n"))
    beside = n.select(F.explode(F.sequence(F.col("chars") - 5, F.col("chars") + 5)).alias("chars"), F.col("n").alias("m")).groupBy("chars").agg(F.sum("m").alias("m"))
    around = n.join(beside, "chars").select("chars", "n", (F.col("m") - F.col("n")).alias("near"))
    return around.where(f"n >= {SPIKE_LEAST} and n > {SPIKE_TIMES} * greatest(near / 10, 1)").select("chars", F.col("n").alias("pile"))


def habits(marked: DataFrame) -> DataFrame:
    """Languages in which responses to finished prompts are finished by a mark as a rule."""
    asked = marked.where("closed and defect is null and habit is not null").groupBy("habit")
    return asked.agg(F.avg(F.col("unfinished").cast("double")).alias("share")).where(F.col("share") <= 1 - HABIT).select("habit")


def explained(units: DataFrame, files: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """``unit_key, defect, evidence`` of every defective pair. Truncation is told by a longer neighbour in the order of responses, else
    by a length limit, else by the lack of a mark that the language's responses to such prompts have."""
    table = model_of(units, files) if table is None else table
    marked = materialise(judged(tagged(units, files), table).dropDuplicates(["unit_key"]))
    # canned answers: one response to many unlike sources of several languages
    by_shape = marked.where("response is not null and source_shape is not null").groupBy("response", "sl", "source_shape").agg(F.count("*").alias("n"))
    canned = by_shape.groupBy("response").agg(F.sum("n").alias("n"), F.count("*").alias("unlike"), F.countDistinct("sl").alias("languages"))
    canned = canned.where(f"n >= {CANNED_LEAST} and unlike >= {CANNED_SHARE} * n and unlike >= {CANNED_PER_LANGUAGE} * greatest(languages, 1)").select("response", F.lit(True).alias("is_canned"))
    asked = skew_join(marked.where("response is not null").select("unit_key", "response", "doubt", "defect"), canned, ["response"], F.col("unit_key"), how="left")
    settled = asked.where("is_canned").select("unit_key", F.lit("refusal").alias("defect")).unionByName(asked.where("is_canned is null and defect is not null").select("unit_key", "defect"))
    certain = marked.where("response is null and defect is not null").select("unit_key", "defect").unionByName(settled)
    refused = asked.where("is_canned and doubt = 'cut'").select("unit_key")
    # copies of words that others translate
    copies = marked.where("doubt = 'copy'").select("unit_key", "h", "sl")
    known = marked.where("skey is not null").groupBy(F.col("skey").alias("h")).agg(F.avg(F.col("differs").cast("double")).alias("share")).where("share >= 0.5")
    copied = skew_join(copies, known, ["h"], F.col("unit_key")).select("unit_key", F.lit("copy").alias("defect"))
    # shortened responses
    shapes = marked.where("shape is not null").groupBy("tl", "shape").agg(F.count("*").alias("n"), F.max(F.col("doubt") == "cut").alias("doubted"))
    shorts = shapes.where("doubted").join(shortened(shapes.where("tl is not null").select("tl", "shape", "n")), ["tl", "shape"], "left")
    rare = shorts.where(f"inside or n <= {CUT_SHARE} * longer").select("tl", "shape")
    cut = marked.where("doubt = 'cut'").select("unit_key", "tl", "shape", "chars", "closed", "habit").join(refused, "unit_key", "left_anti")
    short = skew_join(cut, rare, ["tl", "shape"], F.col("unit_key")).select("unit_key", F.lit("truncated").alias("defect"))
    # where no longer response is known, one text must not be the pile by itself
    alone = shorts.where("tl is not null and longer is null").select("tl", "shape", "n")
    limited = skew_join(cut.join(limits(marked), "chars"), alone, ["tl", "shape"], F.col("unit_key")).where(f"n <= {PILE_SHARE} * pile").select("unit_key", F.lit("truncated").alias("defect"))
    # a prompt that ends with a mark, in a language whose responses then do so too
    bare = cut.where("closed").join(habits(marked), "habit", "left_semi").select("unit_key", F.lit("truncated").alias("defect"))
    told = [(certain, "1 rule"), (copied, "1 others"), (short, "1 neighbour"), (limited, "2 limit"), (bare, "3 mark")]
    every = reduce(DataFrame.unionByName, [df.withColumn("evidence", F.lit(name)) for df, name in told])
    return every.groupBy("unit_key", "defect").agg(F.substring(F.min("evidence"), 3, 20).alias("evidence"))


def found(units: DataFrame, files: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """``unit_key, defect`` of every defective pair."""
    return explained(units, files, table).select("unit_key", "defect")
