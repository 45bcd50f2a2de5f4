"""Queries of packages, of references between documents, and of whole units in the newer version, with their SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segforge.functions import inline as I
from segforge.functions import text as T
from segforge.io import table
from segforge.operators import references
from segforge.operators.units import units
from segforge.plans import formats, inline
from segforge.sources import packages

Query = Callable[[SparkSession, str], DataFrame]
#: Texts of a member of the packages that the queries make.
MEMBER = 5
# Fixed values: (name of member n, what stands before, around and after its texts, name and content of a manifest line).
SPELT = {
    "docx": ("word/header{}.xml", "<w:document><w:p>", "<w:r><w:t xml:space=\"preserve\">{}</w:t></w:r>", "</w:p></w:document>", None),
    "xlsx": ("xl/comments{}.xml", "<sst>", "<si><t>{}</t></si>", "</sst>", None),
    "pptx": ("ppt/slides/slide{}.xml", "<p:sld>", "<a:p><a:r><a:t>{}</a:t></a:r></a:p>", "</p:sld>", None),
    "idml": ("Stories/Story_u{}.xml", "<Story>", "<Content>{}</Content><Br/>", "</Story>", ("designmap.xml", '<idPkg:Story src="{}"/>')),
    "qti": ("item{}.xml", "<assessmentItem><itemBody>", "<p>{}</p>", "</itemBody></assessmentItem>", ("imsmanifest.xml", '<resource type="item" href="{}"/>')),
    "sdlppx": ("de-DE/part{}.sdlxliff", "<xliff>", "<trans-unit id=\"1\"><source>x</source><seg-source>{}</seg-source><target></target></trans-unit>", "</xliff>", None),
}


def made(kind: str, texts: list[str]) -> bytes:
    """A package of the texts; where there is a manifest, its order isn't the members' own."""
    name, before, around, after, manifest = SPELT[kind]
    parts = [texts[i : i + MEMBER] for i in range(0, len(texts), MEMBER)]
    names = [name.format(len(parts) - i if manifest else i + 1) for i in range(len(parts))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("media/image1.png", b"\x89PNG")
        if manifest:
            z.writestr(manifest[0], "<m>" + "".join(manifest[1].format(n) for n in names) + "</m>")
        for n, part in zip(names, parts):
            z.writestr(n, before + "".join(around.format(t.replace("&", "&amp;")) for t in part) + after)
    return out.getvalue()


def roundtrip(kind: str) -> Query:
    """Packages made of the units, read, written with the translations and read again."""

    def query(s: SparkSession, d: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                keys, sources, translations = (c.to_pylist() for c in batch.columns)
                rows = []
                for key, wanted, new in zip(keys, sources, translations):
                    data = made(kind, wanted)
                    got = [x.unit for _, x in packages.slots(kind, data)]
                    back = packages.write(kind, packages.write(kind, data, []), new)
                    rows.append((key, len(got), sum(a == b for a, b in zip(got, wanted)), "\n".join(x.text for _, x in packages.slots(kind, back))))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["file_id", "n_slots", "n_equal", "written"])

        docs = formats.documents(s, d, "xml").select("file_id", "sources", "translations")
        return docs.mapInArrow(run, "file_id bigint, n_slots bigint, n_equal bigint, written string").select("file_id", "n_slots", "n_equal", F.md5("written").alias("digest"))

    query.__name__ = f"roundtrip_{kind}"
    return query


def reference_discovery(s: SparkSession, d: str) -> DataFrame:
    """What two regions reach in at most three steps: nations, customers and orders."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(s, d, "nation").select(name("r", "n_regionkey").alias("node"), name("n", "n_nationkey").alias("ref"))
    edges = edges.unionByName(table(s, d, "customer").select(name("n", "c_nationkey").alias("node"), name("c", "c_custkey").alias("ref")))
    edges = edges.unionByName(table(s, d, "orders").select(name("c", "o_custkey").alias("node"), name("o", "o_orderkey").alias("ref")))
    edges = edges.unionByName(table(s, d, "lineitem").select(name("o", "l_orderkey").alias("node"), name("l", "l_partkey").alias("ref")))
    found = references.discover(edges, table(s, d, "region").where("r_regionkey < 2").select(name("r", "r_regionkey").alias("node")), 3)
    return found.select("node", F.col("depth").cast("bigint").alias("depth"))


def content_references(s: SparkSession, d: str) -> DataFrame:
    """Each unit without target refers to the unit before it in its file; it takes over what the chain of references ends at."""
    u = units(s, d, "file_id", "seg_ord", "target")
    name = lambda o: F.concat(F.col("file_id").cast("string"), F.lit("#"), o.cast("string"))
    empty = F.coalesce(F.trim("target") == "", F.lit(True))
    e = u.select(name(F.col("seg_ord")).alias("id"), F.when(empty, name(F.col("seg_ord") - 1)).alias("ref"), F.col("target").alias("content"))
    return references.take_over(e).select("id", F.coalesce("content", F.lit("")).alias("content"))


def key_scopes(s: SparkSession, d: str) -> DataFrame:
    """Keys of customers looked up in their nation's scope, then in the region's, then in that of everything."""
    n, c = table(s, d, "nation"), table(s, d, "customer")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    scopes = n.select(name("n", F.col("n_nationkey")).alias("scope"), name("r", F.col("n_regionkey")).alias("parent"))
    scopes = scopes.unionByName(table(s, d, "region").select(name("r", F.col("r_regionkey")).alias("scope"), F.lit("root").alias("parent")))
    defined = n.where("n_nationkey % 3 = 0").select(name("n", F.col("n_nationkey")).alias("scope"), F.lit("product").alias("key"), F.col("n_name").alias("value"))
    defined = defined.unionByName(table(s, d, "region").where("r_regionkey % 2 = 0").select(name("r", F.col("r_regionkey")).alias("scope"), F.lit("product").alias("key"), F.col("r_name").alias("value")))
    defined = defined.unionByName(s.createDataFrame([("root", "product", "EVERYTHING")], "scope string, key string, value string"))
    used = c.select(F.col("c_custkey").alias("id"), name("n", F.col("c_nationkey")).alias("scope"), F.when(F.col("c_custkey") % 10 == 0, "none").otherwise("product").alias("key"))
    return references.scoped(defined, used, scopes)


def upgraded_units(s: SparkSession, d: str) -> DataFrame:
    """Units of 1.2 as whole units of 2.x: state and sub-state, inline codes with their data, matches with rounded quality, notes."""
    u = units(s, d, "unit_id", "source", "target", "approved", "translate", "resname").where("source is not null")
    m = table(s, d, "alt_trans").distinct().withColumn("q", T.quality("match_quality")).where("q between 0 and 100").groupBy("unit_key").agg(F.max("q").alias("q"), F.count("*").alias("n"))
    marked = lambda c: I.to_2x(inline.markup(c))
    has = F.coalesce(F.trim("target") != "", F.lit(False))
    state = F.when(has & (F.col("approved") == "yes"), "final").when(has, "translated").otherwise("initial")
    locked = F.when(F.lower("translate") == "no", ' subState="x:locked"').otherwise("")
    note = F.when(F.col("resname").isNotNull(), F.concat(F.lit('<notes><note id="n1">'), I.escape(F.col("resname")), F.lit("</note></notes>"))).otherwise("")
    match = F.when(F.col("q").isNotNull(), F.concat(F.lit('<mtc:matches count="'), F.col("n").cast("string"), F.lit('" best="'), F.col("q").cast("string"), F.lit('"/>'))).otherwise("")
    data = F.array_join(F.transform(I.tags(inline.markup("source")), lambda t, i: F.concat(F.lit('<data id="d'), i.cast("string"), F.lit('">'), I.escape(t), F.lit("</data>"))), "")
    target = F.when(F.col("target").isNotNull(), F.concat(F.lit("<target>"), marked("target"), F.lit("</target>"))).otherwise("")
    return u.join(m, "unit_key", "left").select("unit_key", F.concat(F.lit('<unit id="'), "unit_id", F.lit('">'), match, note, F.lit("<originalData>"), data, F.lit('</originalData><segment state="'), state, F.lit('"'), locked, F.lit("><source>"), marked("source"), F.lit("</source>"), target, F.lit("</segment></unit>")).alias("unit"))


def queries() -> dict[str, Query]:
    return {f"roundtrip_{k}": roundtrip(k) for k in SPELT} | {f.__name__: f for f in (reference_discovery, content_references, key_scopes, upgraded_units)}


def oracle_sql() -> dict[str, str]:
    clean = lambda c: f"trim(regexp_replace(regexp_replace({c}, '[<>]', '', 'g'), '[\\x00-\\x20]+', ' ', 'g'), ' ')"
    one = f"""with u as (select distinct on (unit_key) unit_key, file_id, seg_ord, approved, {clean('source')} as s, {clean('target')} as target from trans_units order by unit_key),
v as (select *, case when approved = 'yes' and regexp_matches(coalesce(target, ''), '\\p{{L}}') then target else s end as t from u where regexp_matches(s, '\\p{{L}}'))
select file_id, count(*) as n_slots, count(*) as n_equal, md5(string_agg(t, chr(10) order by seg_ord, unit_key)) as digest from v group by 1"""
    two = lambda c: inline._2X.replace("(s,", f"({inline.sql_markup(c)},", 1)
    return {f"roundtrip_{k}": one for k in SPELT} | {
        "reference_discovery": """with recursive e as (select 'r' || n_regionkey as node, 'n' || n_nationkey as ref from nation union select 'n' || c_nationkey, 'c' || c_custkey from customer union select 'c' || o_custkey, 'o' || o_orderkey from orders),
w as (select 'r' || r_regionkey as node, 0 as depth from region where r_regionkey < 2 union select e.ref, depth + 1 from w join e using (node) where depth < 3) select node, min(depth)::bigint as depth from w group by 1""",
        "content_references": """with u as (select distinct on (unit_key) * from trans_units order by unit_key), e as (select file_id, seg_ord, coalesce(trim(target, ' ') = '', true) as bare, target from u),
f as (select *, max(case when not bare then seg_ord end) over w as last_full, max(case when prev is distinct from seg_ord - 1 then seg_ord end) over w as run from (select *, lag(seg_ord) over (partition by file_id order by seg_ord) as prev from e) window w as (partition by file_id order by seg_ord))
select f.file_id || '#' || f.seg_ord as id, coalesce(case when f.bare and f.last_full >= f.run then g.target else f.target end, '') as content from f left join e g on g.file_id = f.file_id and g.seg_ord = f.last_full""",
        "key_scopes": """select c_custkey as id, 'n' || c_nationkey as scope, case when c_custkey % 10 = 0 then 'none' else 'product' end as key, case when c_custkey % 10 = 0 then null when n_nationkey % 3 = 0 then n_name when r_regionkey % 2 = 0 then r_name else 'EVERYTHING' end as value from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
        "upgraded_units": f"""with {inline._U}, m as (select unit_key, max(q) as q, count(*) as n from (select distinct on (alt_id) *, case when regexp_matches(match_quality, '^[+-]?[0-9]{{1,9}}$') then try_cast(match_quality as int) end as q from alt_trans order by alt_id) where q between 0 and 100 group by 1)
select u.unit_key, '<unit id="' || unit_id || '">' || case when q is not null then '<mtc:matches count="' || n || '" best="' || q || '"/>' else '' end || case when resname is not null then '<notes><note id="n1">' || {inline._esc('resname')} || '</note></notes>' else '' end
 || '<originalData>' || array_to_string(list_transform(regexp_extract_all({inline.sql_markup('source')}, '<[^>]+>'), lambda x, i: '<data id="d' || (i - 1) || '">' || {inline._esc('x')} || '</data>'), '') || '</originalData><segment state="'
 || case when coalesce(trim(target, ' ') <> '', false) and coalesce(approved = 'yes', false) then 'final' when coalesce(trim(target, ' ') <> '', false) then 'translated' else 'initial' end || '"' || case when coalesce(lower(translate) = 'no', false) then ' subState="x:locked"' else '' end
 || '><source>' || {two('source')} || '</source>' || case when target is not null then '<target>' || {two('target')} || '</target>' else '' end || '</segment></unit>' as unit from u left join m using (unit_key) where source is not null""",
    }
