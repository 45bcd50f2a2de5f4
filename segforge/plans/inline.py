"""Queries of inline tags, codecs and checks, each with the SQL that gives the same rows.

The units' sources get markup by two rules that both engines share: file names become paired tags, numbers between spaces
single tags, quoted words protected markers, and texts with a final period stand between two tags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segforge.functions import codecs, inline
from segforge.functions import text as T
from segforge.io import table
from segforge.operators.units import matches, units

Query = Callable[[SparkSession, str], DataFrame]
# Fixed values: (pattern, replacement of Spark, replacement of SQL).
MARKUP = [
    ("[<>]", "", ""),
    ("([A-Za-z_-]+[0-9]*)\\.([a-z]{2,10})", '<g id="$2">$1</g>', '<g id="\\2">\\1</g>'),
    (" ([0-9]+) ", ' <x id="$1"/><x id="n"/> ', ' <x id="\\1"/><x id="n"/> '),
    ("“([^”<>]*)”", '<mrk mtype="protected">$1</mrk>', '<mrk mtype="protected">\\1</mrk>'),
    ("^([^<>]*)\\.\\z", "<b>$1.</b>", "<b>\\1.</b>"),
    ("^([^<>]*)!\\z", "<ins>$1</ins><del>?</del><ph>x</ph>!", "<ins>\\1</ins><del>?</del><ph>x</ph>!"),
    ("^([^<>]*)\\?\\z", '$1?<mrk type="comment" id="1">why</mrk>', '\\1?<mrk type="comment" id="1">why</mrk>'),
]


def markup(c: str | Column) -> Column:
    for pattern, new, _ in MARKUP:
        c = F.regexp_replace(c, pattern, new)
    return c


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_markup(c: str) -> str:
    for pattern, _, new in MARKUP:
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(new)}, 'g')"
    return c


_U = "u as (select distinct on (unit_key) * exclude (loaded_at) from trans_units order by unit_key)"
_M = f"{_U}, m as (select unit_key, file_id, seg_ord, {sql_markup('source')} as s, {sql_markup('target')} as t from u where source is not null)"
_esc = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_tags = lambda c, p=inline.TAG: f"regexp_extract_all({c}, {_q(p)})"


def _put(c: str, pattern: str, mark: str) -> str:
    """SQL of texts and marks in turn; ``mark`` sees the tag ``x`` and its number ``i`` from 1."""
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({c}, {_q(pattern)}), list_append(list_transform({_tags(c, pattern)}, lambda x, i: {mark}), '')), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '')"


def _numbered(c: str, pattern: str) -> str:
    return _put(c, pattern, f"'<ph id=\"' || (i - 1) || '\">' || {_esc('x')} || '</ph>'")


def _marked(s: SparkSession, d: str) -> DataFrame:
    return units(s, d).where("source is not null").select("unit_key", "file_id", "seg_ord", markup("source").alias("s"), markup("target").alias("t"))


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# tags --------------------------------------------------------------------------------------------------------------


@query(f"with {_M} select unit_key, {_numbered('s', inline.TAG)} as tagged, len({_tags('s')}) as n_tags from m")
def inline_tags(s, d):
    """Tags as numbered placeholders."""
    return _marked(s, d).select("unit_key", inline.numbered(F.col("s")).alias("tagged"), F.size(inline.tags(F.col("s"))).cast("bigint").alias("n_tags"))


@query(f"with {_M} select unit_key, {_numbered('s', f'(?:{inline.TAG})+')} as tagged from m where regexp_matches(s, '><')")
def merge_tags(s, d):
    """Tags in a row as one placeholder."""
    return _marked(s, d).where("s like '%><%'").select("unit_key", inline.merged(F.col("s")).alias("tagged"))


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null)
select doc_id, line_no, {_numbered('line', inline.C_FORMAT)} as tagged from l where regexp_matches(line, {_q(inline.C_FORMAT)})""")
def c_format_tags(s, d):
    """Conversion marks of C in lines of documents as placeholders."""
    lines = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(inline.C_FORMAT)).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), inline.numbered(F.col("line"), inline.C_FORMAT).alias("tagged"))


_EDGE = "regexp_matches(s, '^<[^>]+>')"
_ENDS = "regexp_matches(s, '<[^>]+>\\z')"


@query(f"""with {_M}, e as (select unit_key, s, {_tags('s')} as g, {_EDGE} as lead, {_ENDS} as trail from m),
f as (select unit_key, s, case when lead and (len(g) = 1 or (len(g) = 2 and trail)) then g[1] else '' end as before, case when trail and ((len(g) = 1 and not lead) or (len(g) = 2 and lead)) then g[-1] else '' end as after from e)
select unit_key, before, after, substring(s, length(before) + 1, length(s) - length(before) - length(after)) as text from f where before <> '' or after <> ''""")
def edge_tags(s, d):
    """Tags at the edges that move to the skeleton."""
    before, text, after = inline.edges(F.col("s"))
    return _marked(s, d).select("unit_key", before.alias("before"), after.alias("after"), text.alias("text")).where("before <> '' or after <> ''")


_PURE = "regexp_replace(regexp_replace(s, '<(?:ph|bpt|ept|it|ut)(?:\\s[^>]*)?>[^<]*</(?:ph|bpt|ept|it|ut)>|<(?:x|bx|ex)(?:\\s[^>]*)?/>', '', 'g'), '</?(?:mrk|sub|g)(?:\\s[^>]*)?>', '', 'g')"


@query(f"with {_M} select unit_key, {_PURE} as text, regexp_extract_all(s, '<mrk mtype=\"protected\">([^<]*)</mrk>', 1) as protected from m where s like '%<%'")
def pure_text(s, d):
    """Text without codes, and what is protected in it."""
    return _marked(s, d).where("s like '%<%'").select("unit_key", inline.pure(F.col("s")).alias("text"), inline.protected(F.col("s")).alias("protected"))


@query(f"""with {_M}, f as (select unit_key, list_distinct({_tags('t')}) as x, {_tags('s')} as a, {_tags('t')} as b, t from m where t is not null and regexp_matches(t, '<'))
select unit_key, {_put('t', inline.TAG, "'<ph id=\"' || (case when list_position(a, x) > 0 then list_position(a, x) - 1 else len(a) + i - 1 end) || '\"/>'")} as target from f""")
def shared_tag_ids(s, d):
    """Tags of targets by the numbers of the equal tags of their sources."""
    return _marked(s, d).where("t is not null and t like '%<%'").select("unit_key", inline.shared_ids(F.col("t"), F.col("s")).alias("target"))


@query(f"with {_M}, x as (select unit_key, unnest({_tags('s')}) as tag from m) select unit_key, tag, regexp_extract_all(tag, {_q(inline.ATTRIBUTE)}, 1)[1] as name, regexp_extract_all(tag, {_q(inline.ATTRIBUTE)}, 2)[1] as value, count(*) as n from x where regexp_matches(tag, {_q(inline.ATTRIBUTE)}) group by all")
def tag_attributes(s, d):
    """First attribute of each start tag."""
    each = _marked(s, d).select("unit_key", F.explode(inline.tags(F.col("s"))).alias("tag"))
    first = inline.attributes(F.col("tag"))[0]
    return each.where(F.col("tag").rlike(inline.ATTRIBUTE)).select("unit_key", "tag", first["name"].alias("name"), first["value"].alias("value")).groupBy("unit_key", "tag", "name", "value").agg(F.count("*").alias("n"))


@query("""with f as (select file_id, '<a href="' || original || '" class=''c' || file_id || ''' lang = "' || coalesce(source_language, '') || '">' as tag from files), n as (select file_id, unnest(regexp_extract_all(tag, """ + _q(inline.ATTRIBUTE) + """, 1)) as name, unnest(regexp_extract_all(tag, """ + _q(inline.ATTRIBUTE) + """, 2)) as v1, unnest(regexp_extract_all(tag, """ + _q(inline.ATTRIBUTE) + """, 3)) as v2 from f) select file_id, name, coalesce(v1, '') || coalesce(v2, '') as value from n""")
def html_attributes(s, d):
    """Attributes of a start tag as rows, whatever their quotes."""
    tag = F.concat(F.lit('<a href="'), "original", F.lit("\" class='c"), F.col("file_id").cast("string"), F.lit("' lang = \""), F.coalesce("source_language", F.lit("")), F.lit('">'))
    return table(s, d, "files").select("file_id", F.explode(inline.attributes(tag)).alias("a")).select("file_id", "a.name", "a.value")


@query(f"with {_M} select unit_key, regexp_replace(regexp_replace(s, '<del>[^<]*</del>', '', 'g'), '</?ins>', '', 'g') as accepted from m where s like '%<ins>%'")
def accept_changes(s, d):
    return _marked(s, d).where("s like '%<ins>%'").select("unit_key", inline.without_changes(F.col("s")).alias("accepted"))


@query(f"with {_M} select unit_key, regexp_replace(s, '<mrk type=\"comment\"[^>]*>([^<]*)</mrk>', '\\1', 'g') as text from m where s like '%comment%'")
def drop_comments(s, d):
    return _marked(s, d).where("s like '%comment%'").select("unit_key", inline.without_comments(F.col("s")).alias("text"))


_2X = "regexp_replace(regexp_replace(regexp_replace(s, '<g id=\"([^\"]*)\">', '<pc id=\"\\1\">', 'g'), '</g>', '</pc>', 'g'), '<x id=\"([^\"]*)\"/>', '<ph id=\"\\1\"/>', 'g')"


@query(f"with {_M} select unit_key, {_2X} as as_2x, s as back from m where regexp_matches(s, '<[gx] ')")
def inline_versions(s, d):
    """Inline codes of 1.2 as those of 2.x and back again."""
    return _marked(s, d).where(F.col("s").rlike("<[gx] ")).select("unit_key", inline.to_2x(F.col("s")).alias("as_2x"), inline.to_12(inline.to_2x(F.col("s"))).alias("back"))


_TMX = "regexp_replace(regexp_replace(regexp_replace(s, '<g id=\"([^\"]*)\">', '<bpt type=\"xliff-g\" i=\"\\1\">&lt;g id=\"\\1\"&gt;</bpt>', 'g'), '</g>', '<ept>&lt;/g&gt;</ept>', 'g'), '<x id=\"([^\"]*)\"/>', '<ph type=\"xliff-x\" x=\"\\1\"/>', 'g')"


@query(f"with {_M} select unit_key, {_TMX} as seg from m where regexp_matches(s, '<[gx] ')")
def tmx_inline(s, d):
    return _marked(s, d).where(F.col("s").rlike("<[gx] ")).select("unit_key", inline.to_tmx(F.col("s")).alias("seg"))


@query(f"with {_M} select unit_key, s as restored from m where s like '%<%'")
def tag_restore(s, d):
    """Tags kept in a table of their own and put back into the text by join; the original again."""
    m = _marked(s, d).where("s like '%<%'")
    data = m.select("unit_key", F.posexplode(inline.tags(F.col("s"))).alias("at", "tag"))
    texts = m.select("unit_key", F.posexplode(inline.between(F.col("s"))).alias("at", "text"))
    both = texts.join(data, ["unit_key", "at"], "left").groupBy("unit_key").agg(F.array_sort(F.collect_list(F.struct("at", F.concat("text", F.coalesce("tag", F.lit(""))).alias("p")))).alias("ps"))
    return both.select("unit_key", F.array_join("ps.p", "").alias("restored"))


@query(f"""with {_M}, a as (select unit_key, unnest({_tags('s')}) as tag from m), b as (select unit_key, unnest({_tags('t')}) as tag from m where t is not null), p as (select unit_key from m where t is not null and t <> '')
select unit_key, tag from (select distinct * from b) x where not exists (select 1 from a where a.unit_key = x.unit_key and a.tag = x.tag)""")
def data_references(s, d):
    """Tags of targets that the unit's source doesn't define."""
    m = _marked(s, d)
    return m.select("unit_key", F.explode(inline.tags(F.col("t"))).alias("tag")).distinct().join(m.select("unit_key", F.explode(inline.tags(F.col("s"))).alias("tag")).distinct(), ["unit_key", "tag"], "left_anti")


_AT = lambda c: f"select unit_key, unnest({_tags(c)}) as tag, generate_subscripts({_tags(c)}, 1) as pos from m where t is not null"


@query(f"with {_M}, a as ({_AT('s')}), b as ({_AT('t')}) select unit_key, pos::bigint as place, a.tag as source_tag, b.tag as target_tag from a join b using (unit_key, pos) where a.tag <> b.tag")
def tag_attribute_equality(s, d):
    """Tags at one place of source and target that differ."""
    m = _marked(s, d).where("t is not null")
    side = lambda c, n: m.select("unit_key", F.posexplode(inline.tags(F.col(c))).alias("at", n))
    return side("s", "source_tag").join(side("t", "target_tag"), ["unit_key", "at"]).where("source_tag <> target_tag").select("unit_key", (F.col("at") + 1).cast("bigint").alias("place"), "source_tag", "target_tag")


@query(f"with {_U}, a as (select distinct on (alt_id) * from alt_trans order by alt_id) select alt_id, a.unit_key, a.source is distinct from u.source as source_differs, a.target is distinct from u.target as target_differs from a join u using (unit_key) where a.source is distinct from u.source or a.target is distinct from u.target")
def start_end_pairs(s, d):
    """Rows that refer to a unit and don't agree with it, attribute by attribute."""
    joined = matches(s, d).alias("a").join(units(s, d).alias("u"), "unit_key")
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"u.{c}"))
    return joined.where(differs("source") | differs("target")).select("alt_id", "unit_key", differs("source").alias("source_differs"), differs("target").alias("target_differs"))


_PARTS = lambda c: f"select unit_key, unnest(regexp_extract_all({c}, '[^.!?]+[.!?]?')) as p, generate_subscripts(regexp_extract_all({c}, '[^.!?]+[.!?]?'), 1) as mid from u where {c} is not null"


@query(f"with {_U}, a as ({_PARTS('source')}), b as ({_PARTS('target')}) select unit_key, mid::bigint as mid, a.p as source, b.p as target from a left join b using (unit_key, mid)")
def marker_pairs(s, d):
    """Parts of sources with the parts of targets of the same number."""
    part = lambda c: units(s, d).where(f"{c} is not null").select("unit_key", F.posexplode(F.regexp_extract_all(c, F.lit("([^.!?]+[.!?]?)"), 1)).alias("mid", c))
    return part("source").join(part("target"), ["unit_key", "mid"], "left").select("unit_key", (F.col("mid") + 1).cast("bigint").alias("mid"), "source", "target")


@query(f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents where text is not null),
k as (select doc_id, line_no, regexp_replace(regexp_replace(line, '([A-Za-z_-]+[0-9]*\\.[a-z]{{2,10}})', '`\\1`', 'g'), '“([^”]*)”', '**\\1** [see](a.md)', 'g') as line from l)
select doc_id, line_no, {_numbered('line', inline.MARKDOWN)} as tagged from k where regexp_matches(line, {_q(inline.MARKDOWN)})""")
def markdown_inline(s, d):
    """Inline Markdown of lines as placeholders: code, escapes, links, emphasis, math, tags and short codes."""
    lines = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    marked = F.regexp_replace(F.regexp_replace("line", "([A-Za-z_-]+[0-9]*\\.[a-z]{2,10})", "`$1`"), "“([^”]*)”", "**$1** [see](a.md)")
    return lines.withColumn("line", marked).where(F.col("line").rlike(inline.MARKDOWN)).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), inline.numbered(F.col("line"), inline.MARKDOWN).alias("tagged"))


# codecs ------------------------------------------------------------------------------------------------------------

_MIRROR = "array_to_string(list_transform(regexp_extract_all({}, '..'), lambda p: case when p >= '80' then translate(p[1], '89ABCDEF', 'FEDCBA98') || translate(p[2], '0123456789ABCDEF', 'FEDCBA9876543210') else p end), '')"


@query(f"with {_U} select unit_key, {_MIRROR.format('hex(encode(source))')} as coded, source as back from u where source is not null")
def hex_codec(s, d):
    coded = codecs.bytes_hex(F.col("source"))
    return units(s, d).where("source is not null").select("unit_key", coded.alias("coded"), codecs.from_bytes_hex(coded).alias("back"))


@query("select doc_id, base64(encode(text)) as embedded, md5(text) as digest from documents where text is not null")
def embed_skeleton(s, d):
    """The document in base 64, and the digest of what comes back."""
    coded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "")
    return table(s, d, "documents").where("text is not null").select("doc_id", coded.alias("embedded"), F.md5(F.unbase64(coded)).alias("digest"))


@query("with x as (select file_id, original, case file_id % 4 when 0 then 'EFBBBF' when 1 then 'FEFF' when 2 then 'FFFE' else '' end as h from files) select file_id, case h when 'EFBBBF' then 'UTF-8' when 'FEFF' then 'UTF-16BE' when 'FFFE' then 'UTF-16LE' end as charset from x")
def bom_detect(s, d):
    """Charsets by byte-order marks, put before the names of the files."""
    mark = F.element_at(F.array(*map(F.lit, ["EFBBBF", "FEFF", "FFFE", ""])), (F.col("file_id") % 4 + 1).cast("int"))
    return table(s, d, "files").select("file_id", codecs.bom(F.concat(F.unhex(mark), F.encode("original", "UTF-8"))).alias("charset"))


@query("select file_id, strftime(received_at, '%Y%m%dT%H%M%SZ') as created from files")
def tmx_date(s, d):
    return table(s, d, "files").select("file_id", codecs.tmx_date(F.col("received_at")).alias("created"))


@query(f"with {_U} select unit_key, resname, coalesce(regexp_matches(resname, '^[A-Za-z_:][A-Za-z0-9_:.\\-]*$'), false) as valid, regexp_matches(unit_id, '^[A-Za-z_:][A-Za-z0-9_:.\\-]*$') as valid_id from u")
def name_check(s, d):
    return units(s, d).select("unit_key", "resname", F.coalesce(codecs.is_name(F.col("resname")), F.lit(False)).alias("valid"), codecs.is_name(F.col("unit_id")).alias("valid_id"))


@query(r"""with f as (select product, original, './' || replace(original, '_', '%5F') as p from files where product is not null), g as (select product, min(original) as base from files where product is not null group by 1),
h as (select distinct f.product, original, replace(substring(p, 3), '%5F', '_') as path, list_filter(string_split(regexp_replace(base, '/?[^/]*$', ''), '/'), lambda x: x <> '') as a, list_filter(string_split(original, '/'), lambda x: x <> '') as b from f join g using (product)),
i as (select *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k])) as n from h)
select product, original, path, array_to_string(list_concat(list_transform(range(len(a) - n), lambda x: '..'), b[n + 1:]), '/') as relative, regexp_matches(original, '^(/|[A-Za-z]:[\\/]|[a-z]+://)') as absolute from i""")
def relative_paths(s, d):
    """Originals seen from the folder of the product's first one, after decoding and canonical form."""
    f = table(s, d, "files").where("product is not null")
    base = f.groupBy("product").agg(F.min("original").alias("base"))
    path = codecs.canonical_path(codecs.percent_decoded(F.concat(F.lit("./"), F.replace("original", F.lit("_"), F.lit("%5F")))))
    folder = codecs.canonical_path(F.regexp_replace("base", "/?[^/]*$", ""))
    seen = F.when(folder == "", path).otherwise(codecs.relative_path(folder, path))
    return f.join(base, "product").select("product", "original", path.alias("path"), seen.alias("relative"), codecs.is_absolute(F.col("original")).alias("absolute")).distinct()


@query("select file_id, case when datatype is null then 0 else length(datatype) end as forms from files")
def plural_forms(s, d):
    """Number of plural forms of a header, here as many as the data type has letters."""
    header = F.when(F.col("datatype").isNull(), "Language: x\\n").otherwise(F.concat(F.lit("Plural-Forms: nplurals = "), F.length("datatype").cast("string"), F.lit("; plural=(n != 1);\\n")))
    return table(s, d, "files").select("file_id", codecs.plural_forms(header).cast("bigint").alias("forms"))


@query("with c(code, charset) as (values " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in codecs.CODE_PAGES.items()) + "), p as (select distinct file_id, regexp_extract(upper(coalesce(src_encoding, '')), '(?:CP|WINDOWS-?)([0-9]+)', 1) as code from convert_params) select file_id, code, charset from p left join c using (code)")
def code_pages(s, d):
    """Charsets of the code pages that the parameters name."""
    code = F.regexp_extract(F.upper(F.coalesce("src_encoding", F.lit(""))), "(?:CP|WINDOWS-?)([0-9]+)", 1)
    return table(s, d, "convert_params").select("file_id", code.alias("code")).distinct().select("file_id", "code", codecs.lookup(F.col("code"), codecs.CODE_PAGES).alias("charset"))


@query("with c(datatype, short) as (values " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in codecs.FORMAT_NAMES.items()) + ") select lower(f.datatype) as datatype, short, count(*) as files from files f left join c on lower(f.datatype) = c.datatype group by 1, 2")
def format_names(s, d):
    low = F.lower("datatype")
    return table(s, d, "files").groupBy(low.alias("datatype"), codecs.lookup(low, codecs.FORMAT_NAMES).alias("short")).agg(F.count("*").alias("files"))


@query(f"with {_U} select unit_key, replace(replace(translate(source, '“”', '‹›'), '‹', '<'), '›', '>') as restored from u where regexp_matches(source, '[“”]')")
def restore_marks(s, d):
    """Marks that stand for markup restored; here quotes were exported so."""
    return units(s, d).where(F.col("source").rlike("[“”]")).select("unit_key", codecs.replaced(F.translate("source", "“”", "‹›"), codecs.RESTORED).alias("restored"))


_DE = dict(zip("äöüßé", "äöüßé"))


@query(f"with {_U} select unit_key, source as text from u where regexp_matches(source, '[äöüßé]') and not contains(source, '\\u')")
def unicode_escapes(s, d):
    """Escapes of letters decoded again."""
    escaped = codecs.replaced(F.col("source"), {v: f"\\u{ord(v):04x}" for v in _DE})
    return units(s, d).where(F.col("source").rlike("[äöüßé]") & ~F.contains("source", F.lit("\\u"))).select("unit_key", codecs.from_unicode_escapes(escaped, _DE).alias("text"))


@query(f"with {_U} select unit_key, source as text from u where regexp_matches(source, '[äöüé“&]') and not regexp_matches(source, '&[#A-Za-z0-9]+;')")
def entity_decode(s, d):
    """References of markup decoded: named, decimal and hexadecimal ones."""
    table_ = {"&": "&amp;", "ä": "&auml;", "ö": "&#246;", "ü": "&#xFC;", "é": "&eacute;", "“": "&ldquo;"}
    return units(s, d).where(F.col("source").rlike("[äöüé“&]") & ~F.col("source").rlike("&[#A-Za-z0-9]+;")).select("unit_key", codecs.from_entities(codecs.replaced(F.col("source"), table_)).alias("text"))


@query(f"with {_U} select unit_key, replace(replace(source, '!', ':warning:'), '?', ':star:') as coded, replace(replace(source, '!', '⚠'), '?', '★') as text from u where regexp_matches(source, '[!?]')")
def shortcodes(s, d):
    """Emoji, here put for two marks, as short codes and back."""
    coded = codecs.replaced(F.translate("source", "!?", "⚠★"), {v: k for k, v in codecs.SHORTCODES.items()})
    return units(s, d).where(F.col("source").rlike("[!?]")).select("unit_key", coded.alias("coded"), codecs.replaced(coded, codecs.SHORTCODES).alias("text"))


@query(f"with {_U} select unit_key, substring(source, 5, 3) = 'the' as at_four, source is not null as url_fine from u where source is not null")
def looking_at(s, d):
    """Prefix test at a place; references are taken for valid whenever there are any."""
    return units(s, d).where("source is not null").select("unit_key", codecs.looking_at(F.col("source"), "the", 4).alias("at_four"), F.col("source").isNotNull().alias("url_fine"))


@query("select file_id, '<xliff source-language=\"' || target_language || '\" target-language=\"' || target_language || '\"/>' as head from files where source_language is not null and target_language is not null")
def language_rewrite(s, d):
    """Source languages of a head replaced by the target language."""
    head = F.concat(F.lit('<xliff source-language="'), "source_language", F.lit('" target-language="'), "target_language", F.lit('"/>'))
    f = table(s, d, "files").where("source_language is not null and target_language is not null")
    return f.select("file_id", F.replace(head, F.concat(F.lit('source-language="'), "source_language", F.lit('"')), F.concat(F.lit('source-language="'), "target_language", F.lit('"'))).alias("head"))


# documents and packages --------------------------------------------------------------------------------------------


@query("select rec_id, json_extract_string(payload, '$.xliff.version') as version, json_extract_string(payload, '$.xliff.version') like '2%' as is_2x, json_exists(payload, '$.xliff.file[0].header.skl') or json_exists(payload, '$.xliff.file.header.skl') as has_skeleton from xliff_records where payload is not null and json_valid(payload)")
def version_probe(s, d):
    """Version and kind of each document."""
    v, get = F.get_json_object("payload", "$.xliff.version"), lambda p: F.get_json_object("payload", p).isNotNull()
    return table(s, d, "xliff_records").where(F.try_parse_json("payload").isNotNull()).select("rec_id", v.alias("version"), v.startswith("2").alias("is_2x"), (get("$.xliff.file[0].header.skl") | get("$.xliff.file.header.skl")).alias("has_skeleton"))


@query("select original, count(distinct source_language) as source_languages, count(distinct target_language) as target_languages, count(distinct source_language) <= 1 and count(distinct target_language) <= 1 as consistent from files group by 1")
def consistency(s, d):
    """Whether all deliveries of an original agree in their languages."""
    g = table(s, d, "files").groupBy("original").agg(F.countDistinct("source_language").alias("source_languages"), F.countDistinct("target_language").alias("target_languages"))
    return g.withColumn("consistent", (F.col("source_languages") <= 1) & (F.col("target_languages") <= 1))


@query("select product, list_sort(list(distinct target_language)) as tags from files where target_language is not null group by 1")
def sorted_tags(s, d):
    """Sorted set of the target languages of each product; as many as there are tags."""
    return table(s, d, "files").where("target_language is not null").groupBy("product").agg(F.array_sort(F.collect_set("target_language")).alias("tags"))


@query("select product, '{\"sourceLanguages\":[' || string_agg(distinct '\"' || source_language || '\"', ',' order by '\"' || source_language || '\"') || ']}' as languages from files where source_language is not null group by 1")
def package_languages(s, d):
    """Source languages of each product as one JSON object."""
    g = table(s, d, "files").where("source_language is not null").groupBy("product").agg(F.array_sort(F.collect_set("source_language")).alias("sourceLanguages"))
    return g.select("product", F.to_json(F.struct("sourceLanguages")).alias("languages"))


@query("select kind, count(*) as members, count(distinct name) as names from (select 'file' as kind, original as name from files union all select 'skeleton', skl from convert_params union all select 'document', original from documents) group by 1")
def package_members(s, d):
    """Members of several kinds as one table."""
    part = lambda t, c, k: table(s, d, t).select(F.lit(k).alias("kind"), F.col(c).alias("name"))
    every = part("files", "original", "file").unionByName(part("convert_params", "skl", "skeleton")).unionByName(part("documents", "original", "document"))
    return every.groupBy("kind").agg(F.count("*").alias("members"), F.countDistinct("name").alias("names"))


@query(f"with {_U}, a as (select distinct on (alt_id) * from alt_trans order by alt_id) select alt_id, unit_key, origin from a where unit_key in (select unit_key from u where approved = 'yes')")
def useful_notes(s, d):
    """Only what refers to an approved unit."""
    return matches(s, d).join(units(s, d).where("approved = 'yes'").select("unit_key"), "unit_key", "left_semi").select("alt_id", "unit_key", "origin")


@query(f"with {_U} select unit_key, case when target is not null then 'yes' else approved end as approved, target from u")
def merge_approve(s, d):
    """Before a merge offered matches are dropped and every unit with a target, even an empty one, counts as approved."""
    return units(s, d).select("unit_key", F.when(F.col("target").isNotNull(), "yes").otherwise(F.col("approved")).alias("approved"), "target")


@query("with f as (select distinct original, 'GUID-' || upper(md5(original)) as guid from files) select file_id, skl, 'href=\"' || guid || '\"' as href from (select distinct file_id, skl from convert_params) p join files using (file_id) join f using (original)")
def guid_references(s, d):
    """References to originals rewritten to stable names by join."""
    names = table(s, d, "files").select("original").distinct().withColumn("guid", F.concat(F.lit("GUID-"), F.upper(F.md5("original"))))
    p = table(s, d, "convert_params").select("file_id", "skl").distinct().join(table(s, d, "files").select("file_id", "original"), "file_id").join(names, "original")
    href = F.concat(F.lit('href="'), "original", F.lit('"'))
    return p.select("file_id", "skl", F.replace(href, F.col("original"), F.col("guid")).alias("href"))


@query("select product, original, row_number() over (partition by product order by received_at, file_id) as place from files where product is not null")
def story_order(s, d):
    """Members in the order that the manifest names them in: by arrival."""
    return table(s, d, "files").where("product is not null").select("product", "original", F.row_number().over(Window.partitionBy("product").orderBy("received_at", "file_id")).cast("bigint").alias("place"))


@query("select file_id, 'Y' as known from files where file_id in (select file_id from convert_params where srx is not null)")
def manifest_members(s, d):
    """Files that both the delivery and the manifest have."""
    return table(s, d, "files").join(table(s, d, "convert_params").where("srx is not null").select("file_id"), "file_id", "left_semi").select("file_id", F.lit("Y").alias("known"))


@query("with p as (select distinct file_id, source, src_lang, tgt_lang, format_name, src_encoding, paragraph, is20 from convert_params) select file_id, source, src_lang, tgt_lang, format_name, src_encoding, paragraph = 'yes' as paragraph, is20 from p")
def batch_jobs(s, d):
    """Jobs written as JSON, one object each, and read again."""
    p = table(s, d, "convert_params").select("file_id", "source", "src_lang", "tgt_lang", "format_name", "src_encoding", (F.col("paragraph") == "yes").alias("paragraph"), "is20").distinct()
    job = F.to_json(F.struct("source", "src_lang", "tgt_lang", "format_name", "src_encoding", "paragraph", "is20"))
    read = p.select("file_id", F.from_json(job, "source string, src_lang string, tgt_lang string, format_name string, src_encoding string, paragraph boolean, is20 boolean").alias("j"))
    return read.select("file_id", "j.*")


@query(f"with {_U} select original, '<tr><td>' || replace(replace(replace(original, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td><td>' || count(*) || '</td><td>' || count(*) filter (approved = 'yes') || '</td></tr>' as html from u group by 1")
def stats_report_rows(s, d):
    """Rows of the report, as markup."""
    g = units(s, d).groupBy("original").agg(F.count("*").alias("n"), F.count_if(F.col("approved") == "yes").alias("a"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    return g.select("original", F.concat(F.lit("<tr>"), cell(inline.escape(F.col("original"))), cell(F.col("n").cast("string")), cell(F.col("a").cast("string")), F.lit("</tr>")).alias("html"))


@query(f"with {_U}, h as (select file_id, '<html><head><style>p{{}}</style></head><body><h1>' || file_id || '</h1>' || string_agg('<p>' || regexp_replace(coalesce(source, ''), '[<>]', '', 'g') || '</p><br/>', '' order by seg_ord, unit_key) || '</body></html>' as html, count(*) filter (trim(regexp_replace(coalesce(source, ''), '[<>]', '', 'g')) <> '') as texts, count(*) as n from u group by 1) select file_id, n as paragraphs, n + 1 as opened, length(regexp_replace(regexp_replace(html, '<style>[^<]*</style>', '', 'g'), '<[^>]*>', '', 'g')) as chars from h")
def html_block_stats(s, d):
    """Block elements and text of pages made of the units."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_ord", "unit_key", F.regexp_replace(F.coalesce("source", F.lit("")), "[<>]", "").alias("t")))), lambda x: F.concat(F.lit("<p>"), x["t"], F.lit("</p><br/>"))), "")
    h = units(s, d).groupBy("file_id").agg(body.alias("body")).select("file_id", F.concat(F.lit("<html><head><style>p{}</style></head><body><h1>"), F.col("file_id").cast("string"), F.lit("</h1>"), "body", F.lit("</body></html>")).alias("html"))
    text = F.regexp_replace(F.regexp_replace("html", "<style>[^<]*</style>", ""), "<[^>]*>", "")
    return h.select("file_id", F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("paragraphs"), F.regexp_count("html", F.lit("<(?:p|h[1-6])>")).cast("bigint").alias("opened"), F.length(text).cast("bigint").alias("chars"))


@query(f"with {_U} select unit_key, '<svg><text>' || regexp_replace(coalesce(source, ''), '[<>]', '', 'g') || '</text></svg>' as svg, regexp_matches(regexp_replace(coalesce(source, ''), '[<>]', '', 'g'), '[^ \\t\\n\\r]') as has_text from u")
def svg_text(s, d):
    """Whether a drawing holds text."""
    svg = F.concat(F.lit("<svg><text>"), F.regexp_replace(F.coalesce("source", F.lit("")), "[<>]", ""), F.lit("</text></svg>"))
    return units(s, d).select("unit_key", svg.alias("svg"), svg.rlike("<text[^>]*>[ \\t\\n\\r]*[^ \\t\\n\\r<]").alias("has_text"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
