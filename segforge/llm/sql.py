"""SQL of the training-data queries that SQL can express: sets of copies and pairs that look alike (by the operator's table of looks). The others decode bytes, walk text or iterate; they are
tested against brute force, public libraries and planted cases."""

from __future__ import annotations

import unicodedata

from segforge.llm import lookalikes

# Blocks of scripts written without spaces, as in ``copies``.
_UNSPACED = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{2FDF}\x{3005}-\x{3007}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}"
_FIELDS = ("resname", "source", "note", "lang")


def _words(c: str) -> str:
    folded = f"replace(replace(lower(nfc_normalize({c})), 'ß', 'ss'), 'ς', 'σ')"
    parts = rf"trim(regexp_replace(regexp_replace({folded}, '\p{{Cf}}', '', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'), ' ')"
    return f"regexp_replace(regexp_replace({parts}, ' ([{_UNSPACED}])', '\\1', 'g'), '([{_UNSPACED}]) ', '\\1', 'g')"


def _field(name: str) -> str:
    raw = rf"(regexp_extract(r, '\s{name}\s*=\s*\"([^\"]*)\"', 1) || regexp_extract(r, '\s{name}\s*=\s*''([^'']*)''', 1))"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#10;", " "), ("&#9;", " "), ("&amp;", "&")):
        raw = f"replace({raw}, '{a}', '{b}')"
    return f"case when json_valid(r) then coalesce(json_extract_string(r, '$.{name}'), '') else {raw} end"


_SETS = f"""with x as (select record_id, trim(record, chr(32) || chr(9) || chr(10) || chr(13)) as r from raw_units where record is not null),
k as (select record_id, [{', '.join(_words(_field(n)) for n in _FIELDS)}] as key from x),
s as (select *, min(record_id) over (partition by key) as keep_id from k where list_aggregate(key, 'string_agg', '') <> '')"""


def _look(c: str) -> str:
    """What a text looks like: characters by the table of looks, without ignorable ones, composed."""
    one, more, none = {}, {"\u0e33": "\u0e4d\u0e32", "\u0eb3": "\u0ecd\u0eb2"}, []
    for code in range(0x80, 0x10000):
        x = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        got = lookalikes.look(x)
        if lookalikes.IGNORABLE.match(x):
            none.append(x)
        elif unicodedata.category(x) == "Zs":
            one[x] = " "
        elif got and got != x and len(got) == 1:
            one[x] = got
        elif got and got != x and 0xFB00 <= code < 0xFB07:
            more[x] = got
    bare = f"regexp_replace({c}, '[{''.join(none)}]', '', 'g')"
    for a, b in more.items():
        bare = f"replace({bare}, '{a}', '{b}')"
    quoted = lambda xs: "".join(xs).replace("'", "''")
    return f"nfc_normalize(translate(nfc_normalize({bare}), '{quoted(one)}', '{quoted(one.values())}'))"


def _pairs() -> str:
    return f"""with e as (select unit_key, 'source' as field, source as text from trans_units union select unit_key, 'target', target from trans_units),
v as (select field, text, min(unit_key) as first from e where text is not null and trim(text, ' ') <> '' group by 1, 2), l as (select *, {_look('text')} as look from v),
k as (select a.field, a.text, b.first as other from l a join l b on a.field = b.field and a.look = b.look and a.text <> b.text where regexp_matches(a.look, '[^\\s\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]'))
select distinct least(unit_key, other) as unit_key_a, greatest(unit_key, other) as unit_key_b, field from e join k using (field, text)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _pairs(),
        "p6_found": f"{_SETS} select keep_id, record_id as dup_id from s where record_id <> keep_id",
        "p6_collapsed": f"{_SETS} select keep_id, count(*) as n_copies from s group by 1 union all select record_id, 1 from raw_units where record_id not in (select record_id from s)",
    }
