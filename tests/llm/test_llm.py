import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from segforge.llm import copies, lookalikes, mixing, mojibake, ngrams, pairs, queries, residue, sentences, tokens

DATA = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


# tokens ------------------------------------------------------------------------------------------------------------

TEXTS = [None, "", " ", "a" * 3000, "<|endoftext|> hi", "Wieso? Straße – naïve café\n\n\tx", "日本語の文章です。", "👍🏽 ok", "aaab abab", "don't I'LL 3.14", "x" * 50 + " " * 40 + "y"]


def test_ids_equal_the_public_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = dict(rows(tokens.encode(df)))
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert dict(rows(tokens.count(df))) == {i: len(v) for i, v in got.items()}


def test_pair_test_equals_exact_merging():
    e = tokens.Encoder(tokens.vocabulary_path())
    back = {v: k for k, v in e.tokens.items()}
    rng = random.Random(3)
    ids = [rng.randrange(50000) for _ in range(4000)]
    a, b = np.array(ids[:2000]), np.array(ids[2000:])
    want = [e.exact(back[x] + back[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert e.compatible(a, b).tolist() == want


# copies ------------------------------------------------------------------------------------------------------------

RECORDS = [
    (1, '{"source": "Open the “File” menu.", "lang": "en"}'), (2, '<trans-unit lang="EN" source="open  the FILE menu"/>'), (3, '{"lang":"en","source":"Open File the menu."}'),
    (4, '{"source": "打开“文件”菜单。", "lang": "zh"}'), (5, '{"lang": "zh", "source": "打开文件菜单"}'), (6, None), (7, ""), (8, None), (9, "{broken"), (10, "{BROKEN"), (11, '{"a": null}'), (12, '{"source": "Straße"}'), (13, '{"source": "STRASSE"}'),
]


def test_copies(spark):
    df = spark.createDataFrame(RECORDS, "record_id bigint, record string")
    assert sorted(rows(copies.found(df))) == [(1, 2), (4, 5), (9, 10), (12, 13)]
    assert sum(r["n_copies"] for r in copies.collapse(df).collect()) == len(RECORDS)
    assert rows(copies.found(df.limit(0))) == []


def test_hot_set_of_copies(spark):
    df = spark.range(3000).selectExpr("id as record_id", "case when id % 3 = 0 then '{\"source\": \"hot\"}' else concat('{\"source\": \"w', id, '\"}') end as record", "id as k1")
    assert copies.found(df).count() == 999


# look-alikes -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("a, b, same", [("Open", "Оpen", True), ("Ａbc", "Abc", True), ("é", "é", True), ("a b", "a b", True), ("a​b", "ab", True), ("ﬁle", "file", True), ("A", "a", False), ("a  b", "a b", False), ("é", "e", False), ("1", "l", False), ("x²", "x2", False), ("ｶﾞ", "ガ", True), ("ё", "ë", True)])
def test_look(a, b, same):
    assert (lookalikes.look(a) == lookalikes.look(b)) == same


def test_canonical_form_is_stable():
    for x in TEXTS[1:] + ["ﬀ ＡＢ Ünï", "ΣΑΣ", "İ", "ẞ"]:
        assert lookalikes.canonical_form(lookalikes.canonical_form(x)) == lookalikes.canonical_form(x)
    assert lookalikes.canonical_form(None) is None


def test_lookalike_pairs_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["Open it", "Оpen it", "Open it", "open it", "x", "х", None, " "]
    units = [(i, rng.choice(texts), rng.choice(texts)) for i in range(24)]
    df = spark.createDataFrame(units + units[:3], "unit_key bigint, source string, target string")
    got = set(rows(lookalikes.found(df)))
    every = {(a[0], b[0], f) for a, b in itertools.combinations(units, 2) for c, f in ((1, "source"), (2, "target")) if lookalikes.look(a[c]) and lookalikes.look(a[c]) == lookalikes.look(b[c]) and a[c] != b[c]}
    assert got <= every
    # no link between different texts is lost
    text = {(i, f): u[c] for u in units for i in [u[0]] for c, f in ((1, "source"), (2, "target"))}
    links = lambda pairs_: {(frozenset((text[a, f], text[b, f])), f) for a, b, f in pairs_}
    assert links(got) == links(every) and {x for a, b, f in every for x in ((a, f), (b, f))} == {x for a, b, f in got for x in ((a, f), (b, f))}


# garbled text ------------------------------------------------------------------------------------------------------


def test_garbled_round_trips(spark):
    sound = {"de": "Für die Übersetzung müssen größere Änderungen geprüft werden.", "fr": "Désolé, le fichier a été importé à côté.", "ru": "Перед публикацией проверьте каждую запись.", "ja": "変更内容は保存されました。", "th": "ผู้ดูแลระบบมอบหมายงาน"}
    texts = [(lang, f"{t} {i % 3}") for lang, t in sound.items() for i in range(30)]
    table = mojibake.learn(spark.createDataFrame(texts, "lang string, text string"))
    c = mojibake.Channels(table)
    for lang, own, read_as in [("de", "utf-8", "cp1252"), ("fr", "utf-8", "cp1252"), ("de", "utf-8", "cp850"), ("fr", "utf-8", "mac_roman"), ("de", "mac_roman", "cp1252"), ("ru", "utf-8", "cp1251"), ("ja", "euc_jp", "cp1252"), ("th", "cp874", "cp1252")]:
        try:
            bad = sound[lang].encode(own).decode(read_as)
        except UnicodeDecodeError:
            bad = sound[lang].encode(own).decode("latin-1")
        got = c.search(bad, lang)
        assert got and got[0] == sound[lang], (lang, own, read_as, got)
    for lang, t in sound.items():
        assert not mojibake.suspicious(t, lang)


def test_garbled_cases(spark):
    units = spark.createDataFrame([(1, 1, "GrÃ¼Ã\u009fe"), (2, 1, None), (3, 1, ""), (4, 1, "Wirklich?!"), (5, 1, "f�r"), (6, 9, "plain"), (5, 1, "f�r")], "unit_key bigint, file_id bigint, source string")
    files = spark.createDataFrame([(1, "de-DE")], "file_id bigint, source_language string")
    assert 5 in {r[0] for r in mojibake.found(units, files).collect()}
    assert mojibake.found(units.limit(0), files).count() == 0
    assert mojibake.lost("vers?o do arquivo", "pt") and not mojibake.lost("What?! See a?b=c", "en") and mojibake.lost("?????? ??? 12", "ru")


def test_garbled_into_letters_of_its_own_script(spark):
    ru = "Администраторы могут поручить задачу нескольким переводчикам."
    zh = "系统管理员"
    koi = lambda t: t.encode("koi8_r").decode("cp1251")
    part = koi("Администраторы могут поручить") + " задачу нескольким переводчикам."
    wide = "系统管理员".encode("gb18030").decode("big5")
    assert not any(mojibake.suspicious(t, lang) for t, lang in ((koi(ru), "ru"), (part, "ru"), (wide, "zh")))
    units = [(i, 1, ru) for i in range(200)] + [(i, 2, zh) for i in range(200, 400)] + [(i, 1, part) for i in range(500, 503)] + [(503, 1, koi(ru)), (504, 2, wide), (505, 1, "Задача 12 готова.")]
    df = spark.createDataFrame(units + units[-3:], "unit_key bigint, file_id bigint, source string")
    files = spark.createDataFrame([(1, "ru-RU"), (2, "zh-CN")], "file_id bigint, source_language string")
    got = {r["unit_key"]: r["restored"] for r in mojibake.restored(df, files).collect()}
    assert got.keys() == {500, 501, 502, 503, 504} and {got[k] for k in range(500, 504)} == {ru} and got[504] == zh
    assert {r["unit_key"] for r in mojibake.found(df, files).collect()} == got.keys()


def test_garbled_text_is_found_however_full_the_table_is():
    """Every cell of the model is filled, as a large corpus fills it."""
    units = list(zip(*[c.to_pylist() for c in pq.read_table("/root/testdata/sf0.01/trans_units.parquet", columns=["file_id", "source"]).columns]))
    files = pq.read_table("/root/testdata/sf0.01/files.parquet", columns=["file_id", "source_language"]).to_pydict()
    langs = {i: (x or "").lower().replace("_", "-").split("-")[0] for i, x in zip(files["file_id"], files["source_language"])}
    texts = [(langs.get(f), s) for f, s in units if s and langs.get(f) in ("de", "fr", "es", "pt", "pl") and mojibake.sound(langs.get(f), s)]
    k = len(ngrams.LANGUAGES)
    table = np.zeros((2 * k, ngrams.BUCKETS), np.int64)
    for lang in {x for x, _ in texts}:
        codes, _ = ngrams.codes_of([t for x, t in texts if x == lang])
        grams, (found, _) = ngrams.trigrams(codes), ngrams.words(codes)
        table[ngrams.ROW[lang]] += np.bincount(grams[grams >= 0], minlength=ngrams.BUCKETS)
        table[k + ngrams.ROW[lang]] += np.bincount(found, minlength=ngrams.BUCKETS)
    broken = [(x, t, t.encode("utf-8").decode("cp1252", "replace")) for x, t in dict.fromkeys(texts) if sum(c > "\x7f" for c in t) >= 2][:250]
    broken = [(x, t, b) for x, t, b in broken if "\ufffd" not in b]
    assert len(broken) > 150
    filled = table.copy()
    filled[:k] += np.random.default_rng(1).poisson(2, filled[:k].shape)
    for counts in (table, filled):
        c = mojibake.Channels(counts)
        got = [c.search(b, x) for x, _, b in broken]
        assert sum(g is not None for g in got) >= 0.97 * len(broken)
        assert sum(g is not None and g[0] == t for g, (_, t, _) in zip(got, broken)) >= 0.95 * len(broken)


def test_lost_bytes_are_filled_by_the_lattice(spark):
    zh = ["请打开菜单，然后选择语言。", "术语表已更新。", "修改已经保存到文件。"]
    c = mojibake.Channels(mojibake.learn(spark.createDataFrame([("zh", f"{t}{i % 3}") for t in zh for i in range(40)], "lang string, text string")))
    for t in zh:
        data = t.encode("utf-8")
        broken = data.decode("gb18030", "replace")
        got = c.search(broken, "zh")
        assert got and sum(a == b for a, b in zip(got[0], t)) >= len(t) - 2, (broken, got)
    row = ngrams.ROW["zh"]
    lost = "术语表已更新。".encode("utf-8").decode("latin-1").replace("\xe8\xaf\xad", "\ufffd\ufffd\xad")  # of one character two bytes are lost
    assert c.lattice(lost, "cp1252", "utf-8", row) == "术语表已更新。"


def test_short_texts_of_wide_encodings(spark):
    c = mojibake.Channels(mojibake.learn(spark.createDataFrame([("zh", "打印")] * 50 + [("zh", "文件已打印")] * 50, "lang string, text string")))
    bad = "打印".encode("gb18030").decode("cp1252")
    assert sum(x > "\x7f" for x in bad) >= 2 and c.lattice(bad, "cp1252", "gb18030", ngrams.ROW["zh"]) == "打印"


# sentences ---------------------------------------------------------------------------------------------------------


def test_tokens_of_any_length_before_a_period():
    none = sentences.Evidence()
    word = "x" * 70
    places = [p for p in sentences.places(f"See {word}. Then go.", "en") if p.kind == "period"]
    assert places[0].word == word and sentences.shape_of(word) != sentences.shape_of("y" * 70) != sentences.FILE
    deep = "“" * 3000 + "a. B" + "”" * 3000 + " c."
    assert sentences.cut(deep, "en", lambda w: none)
    assert len(sentences.cut("(a. b) " * 3000, "en", lambda w: none)) >= 1



def cut(text, lang, **known):
    none = sentences.Evidence()
    return [text[a:b] for a, b in sentences.cut(text, lang, lambda w: known.get(w, none))]


def test_sentences():
    e = sentences.Evidence
    assert cut("Who is it?! Yes. “Stop!” he said. Go.", "en", he=e(), Yes=e(ends=5, dots=5), said=e(ends=3, dots=3)) == ["Who is it?!", "Yes.", "“Stop!” he said.", "Go."]
    assert cut("Dr. Who met them.", "en", Dr=e(dots=9, goes_on=0)) == ["Dr. Who met them."]
    assert cut("まだ。「止まれ！」と言った。次", "ja") == ["まだ。", "「止まれ！」と言った。", "次"]
    assert cut("हाँ। नहीं।ठीक", "hi") == ["हाँ।", "नहीं।", "ठीक"]
    assert cut("ส่งงาน Norvik ภายในวันศุกร์ ตรวจงาน", "th") == ["ส่งงาน Norvik ภายในวันศุกร์", "ตรวจงาน"]
    assert cut("One\nline\n\nTwo", "en") == ["One\nline", "Two"]
    assert cut("  \n ", "en") == [] and cut("", None) == []
    assert cut("3.5 MB. 1. Pick it.", "en", MB=e(ends=4, dots=4), **{sentences.NUMBER: e()}) == ["3.5 MB.", "1. Pick it."]


def test_sentence_offsets_cover_the_text(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").selectExpr("doc_id as id", "lower(substring(lang,1,2)) as lang", "cast(null as bigint) as doc", "text")
    got = sentences.sentences(df, df).toPandas().sort_values(["id", "start_char"])
    texts = {r["id"]: r["text"] for r in df.collect()}
    for key, part in got.groupby("id"):
        at = 0
        for a, b in zip(part.start_char, part.end_char):
            assert a >= at and not texts[key][at:a].strip() and b > a and texts[key][a:b].strip() == texts[key][a:b]
            at = b
        assert not texts[key][at:].strip()


def test_evidence_covers_texts_without_periods(spark):
    texts = [("en", None, "Save the File menu"), ("en", 7, "Who sees the File?"), ("en", None, "File it."), ("en", None, ""), ("en", None, None)]
    df = spark.createDataFrame(texts, "lang string, doc bigint, text string")
    got = {(r["doc"], r["word"]): (r["ends"], r["goes_on"], r["dots"], r["starts"], r["mid"]) for r in sentences.evidence_of(df).collect()}
    assert got[None, "File"] == (0, 0, 0, 1, 2) and got[None, "menu"] == (0, 0, 0, 0, 1) and got[7, "File"] == (0, 0, 0, 0, 1) and got[None, "Save"] == (0, 0, 0, 1, 0)


def test_document_outweighs_the_corpus(spark):
    plain = [(100 + i, "en", 9, "We saw the fig.") for i in range(30)]
    short = [(i, "en", 1, "See fig. 3, then fig. 4 and fig. 5 of it") for i in range(3)]
    df = spark.createDataFrame([*plain, *short, (50, "en", 1, "Look at fig. Six of the plan"), (51, "en", 9, "Look at fig. Six of the plan"), (52, "en", None, "Look at fig. Six of the plan"), (53, "en", None, "we met Six there")], "id bigint, lang string, doc bigint, text string")
    got = sentences.sentences(df, df).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got if r["id"] in (50, 51, 52)} == {50: 1, 51: 2, 52: 2}


# pairs -------------------------------------------------------------------------------------------------------------


def test_pair_rules():
    assert pairs.is_nothing("Text", "N/A") and pairs.is_nothing("Text", "—") and pairs.is_nothing(None, " ") and not pairs.is_nothing("…", "…") and not pairs.is_nothing("x", "nachher")
    assert pairs.refuses("I'm sorry, but I can't translate this content.") and not pairs.refuses("Sorry, Galzo cannot open help.rc because the file is damaged.")
    assert pairs.refuses("Es tut mir leid, diesen Text kann ich nicht übersetzen.") and pairs.refuses("很抱歉，我无法翻译这段内容。")
    assert pairs.is_copy("Open the menu now.", "[OPEN THE MENU NOW]") and pairs.is_copy("Open the menu now.", "Answer: Open the menu now.") and not pairs.is_copy("Messages", "Messages reçus")


def test_pairs_found(spark):
    units = [(k, 1, s, t, a) for k, s, t, a in [
        (1, "Open the file now.", "Öffnen Sie jetzt die Datei.", "yes"), (2, "Open the file now.", None, "yes"), (3, "Open the file now.", "I cannot translate this text.", "yes"), (4, "Open the file now.", "open the file now", "yes"),
        (5, "Open the file now.", "Öffnen Sie jetzt die", "yes"), (6, "Open the file now.", None, "no"), (7, None, None, "yes"), (2, "Open the file now.", None, "yes")]]
    df = spark.createDataFrame(units, "unit_key bigint, file_id bigint, source string, target string, approved string")
    files = spark.createDataFrame([(1, "en", "de")], "file_id bigint, source_language string, target_language string")
    assert sorted(rows(pairs.found(df, files))) == [(2, "empty"), (3, "refusal"), (4, "copy"), (5, "truncated"), (7, "empty")]


def test_shortened_against_brute_force(spark):
    rng = random.Random(5)
    words = {("th", "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 7)))) for _ in range(200)} | {("de", "a")}
    got = {(r["tl"], r["shape"]) for r in pairs.shortened(spark.createDataFrame(sorted(words), "tl string, shape string")).collect()}
    assert got == {(l, x) for l, x in words if any(l == m and y != x and y.startswith(x) for m, y in words)}


def test_longer_responses_are_counted_across_ranges(spark):
    rng = random.Random(7)
    words = {("th", "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 7)))): rng.randrange(1, 5) for _ in range(200)} | {("de", "a"): 2, ("de", "ab"): 3}
    df = spark.createDataFrame([(*k, n) for k, n in sorted(words.items())], "tl string, shape string, n bigint")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["tl"], r["shape"]): r["longer"] for r in pairs.shortened(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = {(l, x): sum(n for (m, y), n in words.items() if m == l and y != x and y.startswith(x)) for l, x in words}
    assert got == {k: n for k, n in want.items() if n}


def test_cuts_are_judged_by_their_share(spark):
    source, whole, part = "Import the file {} now.", "นำเข้าไฟล์ {} ไปยังโครงการ แล้วเลือกภาษาที่ต้องการแปล", "นำเข้าไฟล์ {} ไปยังโครงการ"
    for times in (1, 10):
        units = [(k, 1, source.format(f"a{k}.html"), (part if k < times else whole).format(f"a{k}.html"), "yes") for k in range(8 * times)]
        df = spark.createDataFrame(units + units[:1] * 5, "unit_key bigint, file_id bigint, source string, target string, approved string")
        files = spark.createDataFrame([(1, "en", "th")], "file_id bigint, source_language string, target_language string")
        assert sorted(rows(pairs.found(df, files))) == [(k, "truncated") for k in range(times)]


def test_copies_and_cuts_by_their_evidence(spark):
    name = "Casquidhystervalumetraquillbayvexmeterrivenkonorviktorrakgantrynine Pro!"  # over 60 characters, no plain words
    units = [(k, 1, name, f"Übersetzt {k} und fertig.", "yes") for k in range(5)] + [(9, 1, name, name, "yes")]
    units += [(20 + k, 1, f"The file a{k}.txt was read.", f"Die Datei a{k}.txt wurde gelesen und geprüft.", "yes") for k in range(6)] + [(30, 1, "The file a9.txt was read.", "Die Datei a9.txt wurde", "yes")]
    units += [(40, 1, "Where are the bells?", "Dort drüben im", "yes"), (41, 1, "It costs 12 (4)", "Es kostet 12 (4)", "yes")]
    df = spark.createDataFrame(units, "unit_key bigint, file_id bigint, source string, target string, approved string")
    files = spark.createDataFrame([(1, "en", "de")], "file_id bigint, source_language string, target_language string")
    got = {tuple(r) for r in pairs.explained(df, files).collect() if r["defect"] != "wrong_language"}
    assert got == {(9, "copy", "others"), (30, "truncated", "neighbour"), (40, "truncated", "mark")}
    assert pairs.masked("Die Datei a9.txt von Gantry Nine wurde", "de") == "Die w von w wurde" and pairs.finished("Gut. (41)") and not pairs.finished("Gut (41)")


def test_length_limits(spark):
    marked = spark.createDataFrame([(80, "cut")] * 40 + [(n, "cut") for n in range(60, 79)], "chars int, doubt string").selectExpr("*", "true as unfinished", "cast(null as string) as defect")
    assert rows(pairs.limits(marked)) == [(80, 40)]


# mixing ------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(6)
    docs = [(i, "word " * rng.randrange(1, 30), "big" if i % 3 else "small") for i in range(600)] + [(1000, None, "big"), (1001, "", "small"), (1002, "x", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.5, 2), ("m", "none", 0.0, 3)], "mix string, source string, weight double, max_repeats int")
    out = {r["source"]: r for r in mixing.shares(df, weights).collect()}
    assert out["small"]["most_copies"] <= 2 and out["big"]["most_copies"] <= 1 and out["none"]["tokens"] == 0
    assert abs(out["big"]["share"] - 0.5) < 0.02
    small = {r["doc_id"] for r in mixing.mix(df, weights, 400).collect()}
    assert small <= {r["doc_id"] for r in mixing.mix(df, weights, 1500).collect()}


# residue -----------------------------------------------------------------------------------------------------------


def test_residue_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "All is well here."), (5, "x" * 300_000), (6, "key." + "k" * 200 + "=Saved {{name}}"), (6, "404 Not Found")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("k1", F.lit(1)).withColumn("p", F.lit("Lorem ipsum"))
    assert {r[0] for r in residue.found(df).collect()} <= {6}
    assert residue.found(df.limit(0)).count() == 0
    assert {r[0] for r in residue.kept(df).collect()} >= {1, 2, 3, 4, 5}


def test_residue_cut():
    text = "- One thing. “Two!” Three 404\n\n404\nkey=A. B.\na_1.txt 三。四"
    made = residue.Cut(pa.array([text, "", "x"]))
    assert made.p.to_pylist() == ["One thing.", "“Two!”", "Three \x03", "\x03", "key=A. B.", "\x02 三。", "四", "x"]
    assert made.formatted.to_pylist() == [False, False, False, True, True, False, False, False]
    assert made.owner.tolist() == [0] * 7 + [2]
    assert made.before.to_pylist()[:2] == ["", "One thing."] and made.after.to_pylist()[6:] == ["", ""]
    many = residue.Cut(pa.array(["a\n" * 9, "a"]))
    assert many.n.to_pylist() == [None] * 9 + [1] and many.before.to_pylist()[3] is None
    k1, k2 = many.keys()
    assert len(set(zip(k1.tolist(), k2.tolist()))) == 2


def test_residue_is_learnt(spark):
    """Rounds add records, and records whose trusted spellings are hidden from the fit are found all the same."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    table = residue.distinct_passages(docs).cache()
    keys = residue.cut(docs).cache()
    ids = lambda bad: {r[0] for r in keys.join(bad, ["k1", "k2"]).select("doc_id").distinct().collect()}
    all_of = lambda t, rounds=residue.ROUNDS: ids(residue.scored(table, residue.fit(t, rounds)))
    full, first = all_of(table), all_of(table, 0)
    assert len(full - first) >= 30 and len(first - full) <= 2
    trusted = ids(table.where("kind > 0"))
    assert len(full - trusted) >= 150
    half = table.withColumn("kind", F.when(F.col("k1") % 2 == 0, 0).otherwise(F.col("kind")))
    hidden = ids(table.where("kind > 0 and k1 % 2 = 0"))
    assert len(all_of(half) & hidden) >= 0.85 * len(hidden & full)


# trigrams ----------------------------------------------------------------------------------------------------------


def test_trigram_counts(spark):
    df = spark.createDataFrame([("en", "the cat"), ("en", None), (None, "x"), ("xx", "y"), ("de", "der")], "lang string, text string")
    table = ngrams.table_of(ngrams.counts(df, with_words=True), with_words=True)
    assert table[0].sum() == 6 and table[1].sum() == 2 and table[12].sum() == 2
    assert ngrams.table_of(ngrams.counts(df.limit(0))).sum() == 0


def test_all_queries_run(spark):
    for name, q in queries.queries().items():
        assert q(spark, DATA).count() >= 0, name
