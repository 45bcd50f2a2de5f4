"""SQL over the same tables that gives the same rows."""

from __future__ import annotations

from segforge.functions import codecs
from segforge.operators import validate
from segforge.plans import checks, formats, inline, oracle_nested, packages, segmentation

# The same character classes as in the text functions, spelt for this dialect.
_BREAKS = r"[ \t\r\n()?\x{00A0}\x{3001}\x{3002}\x{FF1A}\x{FF01}\x{FF1F}\x{4ECB}]+"
_INNER = r"[.,\-/<>]"
_SPACES = r"[\t-\r\x1C-\x1F \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
_NARROW = r"\x{00}-\x{FF}\x{3001}\x{3002}\x{FF1A}\x{FF01}\x{FF1F}\x{4ECB}"

_U = "u as (select distinct on (unit_key) * exclude (loaded_at) from trans_units order by unit_key)"
_M = "m as (select distinct on (alt_id) *, case when regexp_matches(match_quality, '^[+-]?[0-9]{1,9}$') then try_cast(match_quality as int) end as quality from alt_trans order by alt_id)"


def _words(c: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(coalesce({c}, ''), '{_BREAKS}'), lambda x: x <> ''), "
        f"lambda x: case when not regexp_matches(x, '{_INNER}') or regexp_matches(x, '\\p{{Nd}}') then 1 else len(list_filter(regexp_split_to_array(x, '{_INNER}+'), lambda y: y <> '')) end)), 0)::bigint"
    )


def _spaces(c: str) -> str:
    return f"(length(coalesce({c}, '')) - length(regexp_replace(coalesce({c}, ''), '{_SPACES}', '', 'g')))::bigint"


def _band(q: str) -> str:
    return f"case when {q} = 100 then 'exact' when {q} >= 95 and {q} < 100 then '95' when {q} >= 85 and {q} < 95 then '85' when {q} >= 75 and {q} < 85 then '75' when {q} >= 50 and {q} < 75 then '50' else 'new' end"


def _tag(c: str) -> str:
    parts = f"string_split(replace({c}, '_', '-'), '-')"
    return f"array_to_string(list_prepend(lower({parts}[1]), list_transform({parts}[2:], lambda p: case when length(p) = 2 then upper(p) when length(p) = 4 then upper(p[1]) || lower(p[2:]) else lower(p) end)), '-')"


def _primary(c: str) -> str:
    return f"case when {c} is null then null else lower(regexp_extract({c}, '^[A-Za-z]+')) end"


def _has(c: str) -> str:
    return f"coalesce(trim(regexp_replace({c}, '<[^>]*>', '', 'g'), ' ') <> '', false)"


_TYPED = f"""{_U}, {_M}, q as (select unit_key, max(quality) as quality from m group by 1),
t0 as (select u.*, coalesce(q.quality, 0) as quality, coalesce(lower(approved) = 'yes', false) as is_approved, {_has('target')} as is_translated, coalesce(lower(translate), 'yes') <> 'no' as translatable, {_words('source')} as n
 from u left join q using (unit_key) where source is not null and trim(source, ' ') <> ''),
t as (select unit_key, file_id, original, seg_ord, source, is_approved as approved, is_translated as translated, translatable, case when translatable then n else 0 end::bigint as words, case when translatable then 0 else n end::bigint as untranslatable,
 length(source) - {_spaces('source')} as chars, case when is_approved and coalesce(state = 'signed-off', false) then 'ice' else {_band('quality')} end as type from t0)"""
_REP = f"""{_TYPED}, k as (select *, row_number() over w as rn, first_value(original) over w as first_original from t
 window w as (partition by source, words, untranslatable, chars, approved, translated, type order by lower(original), original, file_id, seg_ord, unit_key)),
r as (select * exclude (type, rn, first_original), case when type <> 'new' then type when rn = 1 then 'new' when first_original = original then 'rep-int' else 'rep-ext' end as type from k)"""
_CTX = """c as (select *, lag(coalesce(source, '')) over w as before, lead(coalesce(source, '')) over w as after from u window w as (partition by file_id order by seg_ord))"""
_EMPTY = "(target is null or trim(target, ' ') = '')"
_LOCKED = "(coalesce(lower(approved), 'no') = 'yes' or coalesce(state, '') = 'final' or coalesce(lower(translate), 'yes') = 'no')"
_LINES = r"l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null)"
_BLOCK = r"regexp_split_to_array(text, '\n[ \t]*\n')"
_BLOCKS = f"b as (select doc_id, unnest({_BLOCK}) as block, generate_subscripts({_BLOCK}, 1) - 1 as pos from documents where text is not null)"
_ICE = f"""with {_U}, {_CTX}, f as (select file_id, original, row_number() over (partition by original order by received_at, file_id) as delivery from files),
x as (select c.* exclude (original), f.original, delivery from c join f using (file_id)),
n as (select * from x where coalesce(lower(approved), 'no') <> 'yes' and coalesce(lower(translate), 'yes') <> 'no' and source is not null and trim(source, ' ') <> ''),
o as (select * from x where approved = 'yes' and target is not null and trim(target, ' ') <> '' and source is not null),
i as (select n.unit_key, arg_max(o.target, struct_pack(a := o.delivery, b := o.seg_ord, c := o.target)) as target from n join o on n.original = o.original and n.source = o.source and (n.before is null or n.before = o.before) and (n.after is null or n.after = o.after) and o.delivery < n.delivery group by 1)"""
_ICE_LINES = """with f as (select doc_id, coalesce(source, '') || '/' || coalesce(lang, '') as original, row_number() over (partition by coalesce(source, '') || '/' || coalesce(lang, '') order by created_at, doc_id) as delivery, text from documents where text is not null),
l as (select doc_id, original, delivery, unnest(string_split(text, chr(10))) as source, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from f),
c as (select *, doc_id || ':' || pos as unit_key, lag(source) over w as before, lead(source) over w as after from l window w as (partition by doc_id order by pos)),
n as (select * from c where trim(source, ' ') <> '')
select n.unit_key, arg_max(o.unit_key, struct_pack(a := o.delivery, b := o.pos, c := o.unit_key)) as target from n join c o on n.original = o.original and n.source = o.source and (n.before is null or n.before = o.before) and (n.after is null or n.after = o.after) and o.delivery < n.delivery group by 1"""


def _status(value: str) -> str:
    one = lambda c, n: f"coalesce(sum(case when {c} then {value} else 0 end), 0)::bigint as {n}"
    return f"with {_TYPED} select original, {one('approved', 'approved')}, {one('not approved', 'not_approved')}, {one('translated', 'translated')}, {one('not translated', 'not_translated')} from t group by rollup(original)"


def _cues() -> str:
    p = r"^\s*([0-9]+)\n([0-9]{2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{3}) --> ([0-9]{2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{3})\n"
    g = lambda i: f"regexp_extract(block, '{p}', {i})"
    ms = lambda i: f"({g(i)}::bigint * 3600000 + {g(i + 1)}::bigint * 60000 + {g(i + 2)}::bigint * 1000 + {g(i + 3)}::bigint)"
    return rf"with {_BLOCKS} select doc_id, {g(1)}::bigint as cue, {ms(2)} as begin_ms, {ms(6)} - {ms(2)} as lasts_ms, length(regexp_replace(block, '^\s*[0-9]+\n[^\n]*\n', ''))::bigint as chars from b where regexp_matches(block, '{p}')"


def oracle_sql() -> dict[str, str]:
    s = "coalesce(sum(case when {} then {} else 0 end), 0)::bigint as {}".format
    sql = {
        "repetition_classify": f"with {_REP} select original, {s(chr(116) + 'ype = ' + repr('new'), 1, 'new')}, {s('type = ' + repr('ice'), 1, 'ice')}, {s('type = ' + repr('rep-int'), 1, 'rep_int')}, {s('type = ' + repr('rep-ext'), 1, 'rep_ext')}, {s('type not in (' + ', '.join(map(repr, ('new', 'ice', 'rep-int', 'rep-ext'))) + ')', 1, 'matches')}, count(*) as segments from r group by rollup(original)",
        "word_bands": f"with {_REP} select original, " + ", ".join(s(f"type = '{v}'", "words", k) for k, v in (("w_new", "new"), ("w_ice", "ice"), ("w_exact", "exact"), ("w_95", "95"), ("w_85", "85"), ("w_75", "75"), ("w_50", "50"))) + f", {s('type like ' + repr('rep%'), 'words', 'w_repeated')}, sum(untranslatable)::bigint as untranslatable, sum(words)::bigint as words from r group by rollup(original)",
        "word_vector": f"""with {_TYPED}, z as (select * exclude (type), case when type = 'new' and row_number() over (partition by original, source, type order by file_id, seg_ord, unit_key) > 1 then 'rep-int' else type end as type from t where translatable)
 select {s("type = 'new'", 'words', 'new')}, {s("type = 'exact'", 'words', 'exact')}, {s("type = 'rep-int'", 'words', 'repeated')}, {s("type = '95'", 'words', 'b95')}, {s("type = '85'", 'words', 'b85')}, {s("type = '75'", 'words', 'b75')}, {s("type = '50'", 'words', 'b50')}, {s('true', 'words', 'all_words')}, {s('approved', 'words', 'approved')}, {s('translated', 'words', 'translated')}, {s("type = 'ice'", 'words', 'ice')} from z""",
        "status_by_segments": _status("1"),
        "status_by_words": _status("words"),
        "status_by_chars": _status("chars"),
        "word_count_by_lang": f"select lang, sum({_words('text')})::bigint as words, count(*) as documents from documents where text is not null group by 1",
        "word_count_cjk": f"with x as (select doc_id, regexp_replace(text, '[^{_NARROW}]', '', 'g') as narrow, length(regexp_replace(text, '[{_NARROW}]', '', 'g'))::bigint as wide from documents where text is not null and lower(substring(lang, 1, 2)) in ('zh', 'ja')) select doc_id, wide + {_words('narrow')} as words, wide from x",
        "char_space_stats": f"select source, sum(length(text))::bigint as chars, sum({_spaces('text')})::bigint as spaces from documents where text is not null group by 1",
        "match_bands": f"with {_M} select {_band('coalesce(quality, 0)')} as band, count(*) as n, count(distinct unit_key) as units from m group by 1",
        "best_match": f"with {_M} select unit_key, quality, alt_id, target from m where quality <= 100 and target is not null qualify row_number() over (partition by unit_key order by quality desc, alt_id) = 1",
        "ice_match": f"{_ICE} select * from i",
        "ice_lines": _ICE_LINES,
        "ice_applied": f"{_ICE} select unit_key, 'yes' as approved, 'signed-off' as state, 'leveraged-inherited' as state_qualifier, target from i",
        "ice_lines_applied": f"select unit_key, 'yes' as approved, 'signed-off' as state, 'leveraged-inherited' as state_qualifier, target from ({_ICE_LINES})",
        "file_match_first": "select original, arg_min(file_id, struct_pack(a := received_at, b := file_id)) as file_id, count(*) as deliveries from files group by 1",
        "skeleton_merge": f"with {_LINES}, {_U}, t as (select source, min(target) as translation from u where approved = 'yes' and target is not null and source is not null group by 1) select doc_id, md5(string_agg(coalesce(translation, line), chr(10) order by line_no)) as digest, count(translation) as n_translated from l left join t on line = source and trim(line, ' ') <> '' group by 1",
        "segment_lite": r"with x as (select doc_id, string_split(regexp_replace(text, '([.?!]+)(\s+)(\S)', '\1' || chr(8233) || '\2\3', 'g'), chr(8233)) as p from documents where text is not null), y as (select doc_id, unnest(p) as segment, (generate_subscripts(p, 1) - 1)::bigint as pos from x) select doc_id, pos, md5(segment) as digest, length(segment)::bigint as chars from y",
        "paragraph_split": f"with {_BLOCKS} select doc_id, count(*) as paragraphs, max(length(block))::bigint as longest from b where trim(block, ' ') <> '' group by 1",
        "normalise_space": rf"with {_U} select unit_key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(source, '\n', ' ', 'g'), '\p{{Z}}+', ' ', 'g'), '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '') as source from u where source is not null",
        "format_detect": r"""with h as (select substring(text, 1, 40960) as h from documents) select case when coalesce(trim(h, ' '), '') = '' then 'empty' when regexp_matches(h, '^\s*<\?xml[^>]*>\s*<xliff') or regexp_matches(h, '^\s*<xliff') then 'xliff'
 when regexp_matches(h, '^\s*(<!DOCTYPE html|<html|<HTML)') then 'html' when regexp_matches(h, '^\s*<\?xml') or regexp_matches(h, '^\s*<[A-Za-z]') then 'xml' when regexp_matches(h, '^WEBVTT') then 'vtt' when regexp_matches(h, '^\s*[0-9]+\n[0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3} --> ') then 'srt'
 when regexp_matches(h, '^\s*[{\[]\s*["{\[]') then 'json' when regexp_matches(h, '^(#.*\n|\s)*(msgctxt|msgid) "') then 'po' when regexp_matches(h, '^(#.*\n|\s)*[A-Za-z0-9_.\-]+\s?=\s?\S') then 'properties' when regexp_matches(h, '^<\?php|^\s*return \[|array\(') then 'php' when regexp_matches(h, '^(#{1,6} |---\n)') then 'markdown' else 'text' end as format, count(*) as n from h group by 1""",
        "pseudo_translate": f"with {_U} select unit_key, case when {_EMPTY} and not {_LOCKED} and source is not null then 'translated' else state end as state, case when {_EMPTY} and not {_LOCKED} and source is not null then translate(source, 'aeiouAEIOU', 'áèîöúÁÈÎÖÚ') else target end as target from u",
        "copy_sources": f"with {_U} select unit_key, case when {_EMPTY} then source else target end as target from u",
        "approve_all": f"with {_U} select case when not {_EMPTY} then 'yes' else approved end as approved, case when not {_EMPTY} then 'final' else state end as state, count(*) as n from u group by 1, 2",
        "remove_targets": f"with {_U} select unit_key, null::varchar as target, null::varchar as approved, case when state is not null then 'initial' end as state from u",
        "convert_state": f"with {_U} select case when coalesce(lower(approved), 'no') = 'yes' and {_has('target')} then 'final' when {_has('target')} then 'translated' else 'initial' end as state_2x, case when coalesce(lower(translate), 'yes') = 'no' then 'locked' end as sub_state, count(*) as n from u group by 1, 2",
        "tmx_export": f"""with {_U}, f as (select file_id, source_language as a, target_language as b from files where source_language is not null and target_language is not null) select unit_key, '<tu tuid="' || file_id || '-' || unit_id || '"><tuv xml:lang="' || {_tag('a')} || '"><seg>' || replace(replace(replace(trim(source, ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</seg></tuv><tuv xml:lang="' || {_tag('b')} || '"><seg>' || replace(replace(replace(trim(target, ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</seg></tuv></tu>' as tu from u join f using (file_id) where approved = 'yes' and source is not null and trim(source, ' ') <> '' and target is not null""",
        "join_documents": f"with {_U}, f as (select file_id, original, (row_number() over (partition by original order by received_at, file_id) - 1)::int as file_no from files) select unit_key, f.original, file_no, seg_ord from u join f using (file_id)",
        "split_by_original": f"with {_U} select original, count(*) as n_units, count(distinct file_id) as n_files, sum(length(coalesce(source, '')))::bigint as chars, min(unit_key) as first_unit from u group by 1",
        "common_path_root": r"""with p as (select distinct product, original from files where product is not null), t as (select product, original, regexp_extract_all(original, '[/\\:]|[^/\\:]+') as x from p), e as (select product, unnest(x) as token, generate_subscripts(x, 1) - 1 as pos from t),
 g as (select product, pos, min(token) as lo, max(token) as hi from e group by 1, 2), z as (select product, min(case when lo <> hi then pos end) as differs, max(pos) as last from g group by 1) select z.product, coalesce(string_agg(lo, '' order by pos), '') as root from z left join g on g.product = z.product and pos < coalesce(differs, last + 1) - 1 group by 1""",
        "compare_documents": f"""with {_U}, f as (select original, arg_min(file_id, struct_pack(x := received_at, y := file_id)) as fa, arg_max(file_id, struct_pack(x := received_at, y := file_id)) as fb from files group by 1), g as (select * from f where fa <> fb),
 a as (select g.original, seg_ord, source, target from g join u on u.file_id = fa), b as (select g.original, seg_ord, source, target from g join u on u.file_id = fb)
 select case when b.original is null then 'removed' when a.original is null then 'added' when a.source is distinct from b.source then 'source' when a.target is distinct from b.target then 'target' else 'same' end as difference, count(*) as n from a full join b on a.original = b.original and a.seg_ord = b.seg_ord group by 1""",
        "duplicate_ids": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
        "dangling_refs": "select 'ref-params' as rule_id, file_id::varchar as key, file_id::varchar as detail from files where file_id not in (select file_id from convert_params) union all select distinct 'ref-unit', alt_id::varchar, unit_key::varchar from alt_trans where unit_key is not null and unit_key not in (select unit_key from trans_units) union all select 'ref-original', doc_id::varchar, original from documents where original is not null and original not in (select original from files where original is not null)",
        "pair_balance": f"with {_U}, x as (select unit_key, coalesce(source, '') as s, coalesce(target, '') as t from u where source like '%<%' or target like '%<%') select unit_key, (len(regexp_extract_all(s, '<[A-Za-z][^>/]*>')) - len(regexp_extract_all(s, '</[A-Za-z][^>]*>')))::bigint as in_source, (len(regexp_extract_all(t, '<[A-Za-z][^>/]*>')) - len(regexp_extract_all(t, '</[A-Za-z][^>]*>')))::bigint as in_target from x",
        "date_check": r"""with x as (select file_id, strftime(received_at, '%Y-%m-%dT%H:%M:%SZ') as g from files), y as (select file_id, case when file_id % 5 = 0 then g[1:10] when file_id % 7 = 0 then g[1:5] || '13' || g[8:20] else g end as t from x) select file_id, regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$') and try_strptime(t, '%Y-%m-%dT%H:%M:%SZ') is not null as valid from y""",
        "language_check": f"with x as (select file_id, 'source' as side, source_language as written from files union all select file_id, 'target', target_language from files), y as (select *, case when written is not null then {_tag('written')} end as tag from x) select file_id, side, written, y.tag, coalesce(written = y.tag, false) as as_should_be, language_name is not null as known, direction from y left join languages l on l.tag = y.tag",
        "attribute_whitelist": f"with {_U}, a as (select 'state' as attribute, state as value from u where state not in ({', '.join(repr(x) for x in validate.STATES)}) union all select 'datatype', datatype from files where datatype not in ({', '.join(repr(x) for x in codecs.FORMAT_NAMES)}) union all select 'source_language', source_language from files where source_language not in (select tag from languages) union all select 'target_language', target_language from files where target_language not in (select tag from languages)) select attribute, value, count(*) as n from a where value is not null group by 1, 2",
        "violations_report": f"""with {_U}, v as (
 select 'dup-unit' as rule_id, file_id || ':' || unit_id as key from u group by file_id, unit_id having count(*) > 1
 union all select 'dup-alt', alt_id::varchar from alt_trans group by alt_id having count(*) > 1
 union all select 'ref-file', unit_key::varchar from u where file_id is not null and file_id not in (select file_id from files)
 union all select 'ref-unit', alt_id::varchar from alt_trans where unit_key is not null and unit_key not in (select unit_key from u)
 union all select 'ref-product', file_id::varchar from files where product is not null and product not in (select product from products)
 union all select 'lang-source', file_id::varchar from files where source_language is not null and source_language not in (select tag from languages)
 union all select 'lang-target', file_id::varchar from files where target_language is not null and target_language not in (select tag from languages)
 union all select 'empty-source', unit_key::varchar from u where coalesce(lower(translate), 'yes') <> 'no' and (source is null or trim(source, ' ') = '')
 union all select 'approved-empty', unit_key::varchar from u where approved = 'yes' and {_EMPTY}
 union all select 'quality', alt_id::varchar from alt_trans where match_quality is not null and (not regexp_matches(match_quality, '^[+-]?[0-9]{{1,9}}$') or try_cast(match_quality as int) not between 0 and 100)
 union all select 'order', unit_key::varchar from u where seg_ord is null) select rule_id, count(*) as n, min(key) as first_key from v group by 1""",
        "json_leaves": "with x as (select event_id, unnest(json_keys(props)) as name, props from events) select event_id, name, json_extract_string(props, '$.' || name)::bigint as value from x",
        "subtitle_parse": _cues(),
        "po_parse": f"""with {_BLOCKS} select doc_id, pos::bigint as entry, regexp_extract(block, '(?m)^msgid "(.*)"$', 1) as msgid, regexp_extract(block, '(?m)^msgstr "(.*)"$', 1) as msgstr, trim(regexp_extract(block, '(?m)^msgstr "(.*)"$', 1), ' ') <> '' and not regexp_matches(block, '(?m)^#,.*fuzzy') as approved from b where regexp_matches(block, '(?m)^msgid "') and regexp_matches(block, '(?m)^msgstr "')""",
        "properties_parse": rf"with {_LINES} select doc_id, line_no::bigint as line_no, regexp_extract(line, '^([A-Za-z0-9_.\-]+)=(.*)$', 1) as name, regexp_extract(line, '^([A-Za-z0-9_.\-]+)=(.*)$', 2) as value from l where regexp_matches(line, '^([A-Za-z0-9_.\-]+)=(.*)$')",
        "status_history": f"with {_U}, x as (select modified_at::date as day, count(*) as units, count(*) filter (approved = 'yes') as approved from u group by 1) select day, units, approved, (sum(units) over (order by day))::bigint as so_far, units - lag(units) over (order by day) as change from x",
        "status_codec": f"with {_U}, x as (select file_id, count(*) as n, count(*) filter (approved = 'yes') as a from u group by 1) select file_id, 'all=' || n || ';approved=' || a || ';' as line, n as all_back, a as approved_back from x",
        "status_bars": f"with {_TYPED} select file_id, floor(seg_ord / 8)::bigint as bucket, count(*) as n, count(*) filter (approved) as n_approved, round(avg(translated::int), 6) as translated_share, count(*) filter (approved) > floor(count(*) / 2) as approved from t group by 1, 2",
        "merge_adjacent": "with x as (select *, coalesce((lag(event_type) over w <> event_type)::int, 1) as b from events window w as (partition by user_id order by ts, event_id)), y as (select *, (sum(b) over (partition by user_id order by ts, event_id))::bigint as run from x) select user_id, run, min(event_type) as event_type, count(*) as n, min(event_id) as first_event from y group by 1, 2",
        "renumber_ids": f"with {_U} select unit_key, row_number() over (partition by file_id order by seg_ord) - 1 as new_id from u where coalesce(lower(translate), 'yes') <> 'no'",
        "slide_sort": "with x as (select distinct original, regexp_extract(original, '([0-9]+)[^0-9]*$', 1) as n from files) select original, case when n = '' then original else regexp_replace(original, '[0-9]+[^0-9]*$', '') || lpad(n, 8, '0') end as sort_key from x",
        "tag_multiset_diff": f"with {inline._M}, x as (select unit_key, unnest(regexp_extract_all(s, '<[^>]+>')) as tag, 1 as v from m where t is not null union all select unit_key, unnest(regexp_extract_all(t, '<[^>]+>')), -1 from m where t is not null), y as (select unit_key, tag, sum(v) as diff from x group by 1, 2) select unit_key, sum(abs(diff))::bigint as errors from y where diff <> 0 group by 1",
        "inherit_translate": "select c_custkey, coalesce(case when c_custkey % 7 = 0 then 'no' when c_custkey % 7 = 1 then 'yes' end, case when n_nationkey % 5 = 0 then 'no' when n_nationkey % 5 = 1 then 'yes' end, case when r_regionkey % 3 = 0 then 'no' when r_regionkey % 3 = 1 then 'yes' end, 'yes') as translate from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
        "filter_values": "select doc_id, len(list_filter(string_split(source, '_'), lambda x: x not in ('legal', 'notices', 'chat', 'support', 'release'))) = 0 as excluded from documents where source is not null",
        "key_scope_resolve": "with recursive e as (select 'n' || n_nationkey as k, 'r' || n_regionkey as ref from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 'o' || o_orderkey, 'c' || o_custkey from orders union all select 'x' || o_orderkey, 'o' || o_orderkey from orders), w as (select k, ref as pos, 1 as steps from e union all select w.k, e.ref, steps + 1 from w join e on w.pos = e.k) select k, arg_max(pos, steps) as ends_at, max(steps)::bigint as steps from w group by 1",
        "unit_regroup": f"with {_U} select file_id, floor(seg_ord / 3)::bigint as unit_no, md5(string_agg(coalesce(source, ''), '' order by seg_ord)) as source_md5, md5(string_agg(coalesce(target, source, ''), '' order by seg_ord)) as target_md5, coalesce(bool_or(coalesce(state = 'final', false)), false) as approved, count(*) as n_segments from u group by 1, 2",
        "metadata_pivot": "select p_partkey, p_brand as brand, p_type as type, p_size::varchar as size from part",
        "language_directions": f"with x as (select file_id, {_primary('source_language')} as sl, {_primary('target_language')} as tl from files) select sl, tl, count(*) as files, min(file_id) as first_file from x where sl is not null and tl is not null group by 1, 2",
        "encoding_names": "with x as (select file_id, any_value(src_encoding) as e from convert_params group by 1), y as (select e, regexp_replace(upper(e), '[^A-Z0-9]', '', 'g') as b from x) select case when b = 'UTF8' then 'UTF-8' when b in ('CP1252', 'WINDOWS1252') then 'windows-1252' when b in ('LATIN1', 'ISO88591') then 'ISO-8859-1' when e is null then '(none)' else upper(e) end as encoding, count(*) as files from y group by 1",
        "target_names": rf"with x as (select file_id, original, {_tag('target_language')} as l from files where target_language is not null) select file_id, case when regexp_matches(original, '\.[^./]+$') then regexp_replace(original, '\.[^./]+$', '') || '_' || l || regexp_extract(original, '(\.[^./]+)$', 1) else original || '_' || l end as target_file from x",
        "originals_without_params": "select distinct original from documents where original is not null except select original from files where file_id in (select file_id from convert_params)",
        "shared_sources": f"with {_U} select source, count(*) as n from u where source in (select source from alt_trans where source is not null) group by 1",
        "revenue_rollup": "select l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by rollup(l_returnflag, l_linestatus)",
    }
    return sql | oracle_nested.oracle_sql() | formats.oracle_sql() | inline.oracle_sql() | checks.oracle_sql() | segmentation.oracle_sql() | packages.oracle_sql()
