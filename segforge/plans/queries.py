"""Queries over the project's tables, one for each operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segforge.functions import codecs
from segforge.functions import text as T
from segforge.io import table
from segforge.operators import assemble, keys, leverage, nested, rewrite, stats, validate
from segforge.operators.units import best_quality, matches, typed, units
from segforge.plans import checks, formats, inline, packages, segmentation
from segforge.sources import lines

BOM = 8  # size of the bars of status reports


def _docs(s, d):
    return table(s, d, "documents")


def _langs(s, d):
    f = table(s, d, "files")
    return f.select("file_id", T.primary_tag("source_language").alias("sl"), T.primary_tag("target_language").alias("tl"))


def repetition_classify(s, d):
    return stats.segment_types(stats.repetitions(typed(s, d)))


def word_bands(s, d):
    return stats.word_bands(stats.repetitions(typed(s, d)))


def word_vector(s, d):
    return stats.word_vector(typed(s, d))


def status_by_segments(s, d):
    return stats.status(typed(s, d), "1")


def status_by_words(s, d):
    return stats.status(typed(s, d), "words")


def status_by_chars(s, d):
    return stats.status(typed(s, d), "chars")


def word_count_by_lang(s, d):
    docs = _docs(s, d).where("text is not null")
    return docs.groupBy("lang").agg(F.sum(T.words("text")).cast("bigint").alias("words"), F.count("*").alias("documents"))


def word_count_cjk(s, d):
    docs = _docs(s, d).where("text is not null and lower(substring(lang, 1, 2)) in ('zh', 'ja')")
    return docs.select("doc_id", T.words_cjk("text").alias("words"), T.wide_characters("text").alias("wide"))


def char_space_stats(s, d):
    docs = _docs(s, d).where("text is not null")
    return docs.groupBy("source").agg(F.sum(F.length("text")).cast("bigint").alias("chars"), F.sum(T.spaces("text")).cast("bigint").alias("spaces"))


def match_bands(s, d):
    return matches(s, d).groupBy(T.band(F.coalesce("quality", F.lit(0))).alias("band")).agg(F.count("*").alias("n"), F.countDistinct("unit_key").alias("units"))


def best_match(s, d):
    m = matches(s, d).where("quality is not null and quality <= 100 and target is not null")
    best = m.groupBy("unit_key").agg(F.max(F.struct("quality", (-F.col("alt_id")).alias("first"), "target")).alias("b"))
    return best.select("unit_key", F.col("b.quality").alias("quality"), (-F.col("b.first")).alias("alt_id"), F.col("b.target").alias("target"))


def ice_match(s, d):
    """Units of every delivery leveraged from the earlier deliveries of its original."""
    f = leverage.deliveries(table(s, d, "files")).select("file_id", "original", "delivery")
    return leverage.from_earlier(leverage.in_context(units(s, d)).drop("original").join(f, "file_id"))


def ice_lines(s, d):
    """Lines of documents leveraged from the earlier documents of their kind and language, in order of their dates; the target is the
    place that a line comes from."""
    docs = _docs(s, d).where("text is not null").withColumn("original", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit(""))))
    docs = docs.select("doc_id", "original", F.row_number().over(Window.partitionBy("original").orderBy("created_at", "doc_id")).alias("delivery"), "text")
    rows = docs.select("doc_id", "original", "delivery", F.posexplode(F.split("text", "\n")).alias("seg_ord", "source"))
    u = rows.withColumnRenamed("doc_id", "file_id").withColumn("unit_key", F.concat(F.col("file_id").cast("string"), F.lit(":"), F.col("seg_ord").cast("string")))
    u = u.withColumn("target", F.col("unit_key")).withColumn("approved", F.lit("yes")).withColumn("translate", F.lit("yes"))
    return leverage.from_earlier(leverage.in_context(u), approved_too=True)


def ice_applied(s, d):
    u = units(s, d)
    return rewrite.apply_leverage(u, ice_match(s, d)).where("state_qualifier is not null").select("unit_key", "approved", "state", "state_qualifier", "target")


def ice_lines_applied(s, d):
    """Lines of documents as units, approved where an earlier document gives their target."""
    rows = assemble.lines(_docs(s, d)).select(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("line_no").cast("string")).alias("unit_key"), "line")
    u = rows.select("unit_key", F.lit("new").alias("state"), F.lit(None).cast("string").alias("approved"), F.lit(None).cast("string").alias("target"))
    return rewrite.apply_leverage(u, ice_lines(s, d)).where("state_qualifier is not null").select("unit_key", "approved", "state", "state_qualifier", "target")


def file_match_first(s, d):
    f = table(s, d, "files")
    first = f.groupBy("original").agg(F.min(F.struct("received_at", "file_id")).alias("first"), F.count("*").alias("deliveries"))
    return first.select("original", F.col("first.file_id").alias("file_id"), "deliveries")


def skeleton_merge(s, d):
    """Documents whose lines are replaced by translations that some approved unit holds."""
    rows = assemble.lines(_docs(s, d))
    memory = units(s, d).where("approved = 'yes' and target is not null and source is not null").groupBy("source").agg(F.min("target").alias("translation"))
    found = rows.select("doc_id", "line_no", "line").where("trim(line) <> ''").join(memory, F.col("line") == F.col("source")).select("doc_id", "line_no", "translation")
    return assemble.merge(rows, found).select("doc_id", F.md5("text").alias("digest"), "n_translated")


def segment_lite(s, d):
    docs = _docs(s, d).where("text is not null")
    return docs.select("doc_id", F.posexplode(T.sentence_lite("text")).alias("pos", "segment")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.md5("segment").alias("digest"), F.length("segment").cast("bigint").alias("chars"))


def paragraph_split(s, d):
    p = lines.paragraphs(_docs(s, d))
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max(F.length("paragraph")).cast("bigint").alias("longest"))


def normalise_space(s, d):
    return units(s, d).where("source is not null").select("unit_key", T.normalise("source").alias("source"))


def format_detect(s, d):
    return _docs(s, d).groupBy(lines.detect_format(F.col("text")).alias("format")).agg(F.count("*").alias("n"))


def pseudo_translate(s, d):
    return rewrite.pseudo_translate(units(s, d)).select("unit_key", "state", "target")


def copy_sources(s, d):
    return rewrite.copy_sources(units(s, d)).select("unit_key", "target")


def approve_all(s, d):
    return rewrite.approve_all(units(s, d)).groupBy("approved", "state").agg(F.count("*").alias("n"))


def remove_targets(s, d):
    return rewrite.remove_targets(units(s, d)).select("unit_key", "target", "approved", "state")


def convert_state(s, d):
    return rewrite.state_2x(units(s, d)).groupBy("state_2x", "sub_state").agg(F.count("*").alias("n"))


def tmx_export(s, d):
    u = units(s, d).where("approved = 'yes' and source is not null and trim(source) <> '' and target is not null")
    f = table(s, d, "files").select("file_id", "source_language", "target_language").where("source_language is not null and target_language is not null")
    tuid = F.concat(F.col("file_id").cast("string"), F.lit("-"), F.col("unit_id"))
    return u.join(f, "file_id").select("unit_key", assemble.tmx_unit(F.col("source"), F.col("target"), T.clean_tag("source_language"), T.clean_tag("target_language"), tuid).alias("tu"))


def join_documents(s, d):
    """Deliveries of one original joined: files numbered by arrival, units by file and place."""
    f = table(s, d, "files").withColumn("file_no", F.row_number().over(Window.partitionBy("original").orderBy("received_at", "file_id")) - 1)
    u = units(s, d).select("unit_key", "file_id", "seg_ord")
    return u.join(f.select("file_id", "original", "file_no"), "file_id").select("unit_key", "original", "file_no", "seg_ord")


def split_by_original(s, d):
    return units(s, d).groupBy("original").agg(F.count("*").alias("n_units"), F.countDistinct("file_id").alias("n_files"), F.sum(F.length(F.coalesce("source", F.lit("")))).cast("bigint").alias("chars"), F.min("unit_key").alias("first_unit"))


def common_path_root(s, d):
    return assemble.path_root(table(s, d, "files").where("product is not null"), "original", "product")


def compare_documents(s, d):
    """First delivery of each original against its last, place by place."""
    f = table(s, d, "files").groupBy("original").agg(F.min(F.struct("received_at", "file_id")).alias("a"), F.max(F.struct("received_at", "file_id")).alias("b"))
    f = f.where("a.file_id <> b.file_id").select("original", F.col("a.file_id").alias("fa"), F.col("b.file_id").alias("fb"))
    u = units(s, d).select("file_id", "seg_ord", "source", "target")
    side = lambda c: f.select("original", F.col(c).alias("file_id")).join(u, "file_id").select("original", "seg_ord", "source", "target")
    return assemble.compare(side("fa"), side("fb"), ["original", "seg_ord"]).groupBy("difference").agg(F.count("*").alias("n"))


def duplicate_ids(s, d):
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


def dangling_refs(s, d):
    """Files without parameters, matches without unit, documents of originals that were never delivered."""
    a = validate.dangling("ref-params", table(s, d, "files").select("file_id"), "file_id", "file_id", table(s, d, "convert_params"), "file_id")
    b = validate.dangling("ref-unit", matches(s, d), "alt_id", "unit_key", units(s, d, "file_id"), "unit_key")
    c = validate.dangling("ref-original", _docs(s, d), "doc_id", "original", table(s, d, "files"), "original")
    return a.unionByName(b).unionByName(c)


def pair_balance(s, d):
    u = units(s, d)
    side = lambda c: F.coalesce(validate.pair_balance(F.col(c)), F.lit(0)).cast("bigint")
    return u.where("source like '%<%' or target like '%<%'").select("unit_key", side("source").alias("in_source"), side("target").alias("in_target"))


def date_check(s, d):
    """Arrival times written in the fixed form, some of them broken on purpose by their id."""
    f = table(s, d, "files")
    good = F.date_format(F.col("received_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(F.col("file_id") % 5 == 0, F.substring(good, 1, 10)).when(F.col("file_id") % 7 == 0, F.concat(F.substring(good, 1, 5), F.lit("13"), F.substring(good, 8, 13))).otherwise(good)
    return f.select("file_id", validate.date_valid(text).alias("valid"))


def language_check(s, d):
    f, l = table(s, d, "files"), table(s, d, "languages").select("tag", "language_name", "direction")
    long = f.select("file_id", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source_language").alias("written")), F.struct(F.lit("target").alias("side"), F.col("target_language").alias("written")))).alias("x")).select("file_id", "x.*")
    out = long.withColumn("tag", T.clean_tag("written")).join(l, "tag", "left")
    return out.select("file_id", "side", "written", "tag", F.coalesce(F.col("written") == F.col("tag"), F.lit(False)).alias("as_should_be"), F.col("language_name").isNotNull().alias("known"), "direction")


def attribute_whitelist(s, d):
    """Values of attributes that aren't among the allowed ones: states of units, data types and language tags of files."""
    f, tags = table(s, d, "files"), table(s, d, "languages").select(F.col("tag").alias("value"))
    fixed = lambda values: s.createDataFrame([(x,) for x in values], "value string")
    part = lambda df, c, allowed: df.select(F.lit(c).alias("attribute"), F.col(c).alias("value")).where("value is not null").join(allowed, "value", "left_anti")
    every = part(units(s, d, "state"), "state", fixed(validate.STATES)).unionByName(part(f, "datatype", fixed(codecs.FORMAT_NAMES))).unionByName(part(f, "source_language", tags)).unionByName(part(f, "target_language", tags))
    return every.groupBy("attribute", "value").agg(F.count("*").alias("n"))


def violations_report(s, d):
    v = validate.violations(units(s, d), table(s, d, "files"), table(s, d, "alt_trans"), table(s, d, "products"), table(s, d, "languages"))
    return v.groupBy("rule_id").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def json_leaves(s, d):
    return lines.json_leaves(table(s, d, "events"), "event_id", "props").select("event_id", "name", F.col("value").cast("bigint").alias("value"))


def subtitle_parse(s, d):
    c = lines.cues(_docs(s, d))
    return c.select("doc_id", "cue", "begin_ms", (F.col("end_ms") - F.col("begin_ms")).alias("lasts_ms"), F.length("cue_text").cast("bigint").alias("chars"))


def po_parse(s, d):
    return lines.po_entries(_docs(s, d)).select("doc_id", F.col("entry").cast("bigint").alias("entry"), "msgid", "msgstr", "approved")


def properties_parse(s, d):
    return lines.properties(_docs(s, d)).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "name", "value")


def status_history(s, d):
    days = units(s, d).groupBy(F.to_date("modified_at").alias("day")).agg(F.count("*").alias("units"), F.count_if(F.col("approved") == "yes").alias("approved"))
    w = Window.orderBy("day")  # one row a day
    return days.select("day", "units", "approved", F.sum("units").over(w).alias("so_far"), (F.col("units") - F.lag("units").over(w)).alias("change"))


def status_codec(s, d):
    g = units(s, d).groupBy("file_id").agg(F.count("*").alias("all"), F.count_if(F.col("approved") == "yes").alias("approved"))
    line = F.concat(F.lit("all="), F.col("all").cast("string"), F.lit(";approved="), F.col("approved").cast("string"), F.lit(";"))
    back = F.str_to_map(F.rtrim(line, F.lit(";")), F.lit(";"), F.lit("="))
    return g.select("file_id", line.alias("line"), back["all"].cast("bigint").alias("all_back"), back["approved"].cast("bigint").alias("approved_back"))


def status_bars(s, d):
    return stats.bars(typed(s, d), BOM)


def merge_adjacent(s, d):
    """Runs of equal event types of each user."""
    e = table(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marked = e.withColumn("begins", F.coalesce((F.lag("event_type").over(w) != F.col("event_type")).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("begins").over(w).cast("bigint"))
    return runs.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def renumber_ids(s, d):
    w = Window.partitionBy("file_id").orderBy("seg_ord")
    return units(s, d).where("coalesce(lower(translate), 'yes') <> 'no'").select("unit_key", (F.row_number().over(w) - 1).cast("bigint").alias("new_id"))


def slide_sort(s, d):
    """Padded sort keys of originals with numbers in them."""
    f = table(s, d, "files").select("original").distinct()
    n = F.regexp_extract("original", "([0-9]+)[^0-9]*$", 1)
    return f.select("original", F.when(n == "", F.col("original")).otherwise(F.concat(F.regexp_replace("original", "[0-9]+[^0-9]*$", ""), F.lpad(n, 8, "0"))).alias("sort_key"))


def tag_multiset_diff(s, d):
    """Tags that the marked-up source and target don't share, as multisets."""
    u = units(s, d, "source", "target").where("source is not null and target is not null").select("unit_key", inline.markup("source").alias("source"), inline.markup("target").alias("target"))
    tags = lambda c, v: u.select("unit_key", F.explode(F.regexp_extract_all(c, F.lit("(<[^>]+>)"), 1)).alias("tag"), F.lit(v).alias("v"))
    diff = tags("source", 1).unionByName(tags("target", -1)).groupBy("unit_key", "tag").agg(F.sum("v").alias("diff")).where("diff <> 0")
    return diff.groupBy("unit_key").agg(F.sum(F.abs("diff")).cast("bigint").alias("errors"))


def inherit_translate(s, d):
    """Settings inherited down three levels: the nearest that is set wins."""
    r, n, c = table(s, d, "region"), table(s, d, "nation"), table(s, d, "customer")
    flag = lambda k, m: F.when(F.col(k) % m == 0, "no").when(F.col(k) % m == 1, "yes")
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("c_custkey", F.coalesce(flag("c_custkey", 7), flag("n_nationkey", 5), flag("r_regionkey", 3), F.lit("yes")).alias("translate"))


def filter_values(s, d):
    """Excluded if all tokens of an attribute are in the excluded set."""
    docs = _docs(s, d).where("source is not null")
    tokens, excluded = F.split("source", "_"), F.array(*map(F.lit, ["legal", "notices", "chat", "support", "release"]))
    return docs.select("doc_id", (F.size(F.array_except(tokens, excluded)) == 0).alias("excluded"))


def key_scope_resolve(s, d):
    """Chains of references followed to their ends: a part of an order's line to its customer, nation and region."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(s, d, "nation").select(name("n", "n_nationkey").alias("k"), name("r", "n_regionkey").alias("ref"))
    edges = edges.unionByName(table(s, d, "customer").select(name("c", "c_custkey").alias("k"), name("n", "c_nationkey").alias("ref")))
    edges = edges.unionByName(table(s, d, "orders").select(name("o", "o_orderkey").alias("k"), name("c", "o_custkey").alias("ref")))
    edges = edges.unionByName(table(s, d, "orders").select(name("x", "o_orderkey").alias("k"), name("o", "o_orderkey").alias("ref")))
    return keys.resolve(edges)


def unit_regroup(s, d):
    """Every three segments of a file as one unit."""
    u = units(s, d).withColumn("unit_no", F.floor(F.col("seg_ord") / 3).cast("bigint")).withColumn("source", F.coalesce("source", F.lit("")))
    out = assemble.regroup(u, ["file_id", "unit_no"], "seg_ord")
    return out.select("file_id", "unit_no", F.md5("source").alias("source_md5"), F.md5("target").alias("target_md5"), "approved", "n_segments")


def metadata_pivot(s, d):
    """Attributes of parts to rows and back to one map, counted by name."""
    p = table(s, d, "part")
    rows = p.select("p_partkey", F.explode(F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"))).alias("name", "value"))
    back = rows.groupBy("p_partkey").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    return back.select("p_partkey", F.col("m")["brand"].alias("brand"), F.col("m")["type"].alias("type"), F.col("m")["size"].alias("size"))


def language_directions(s, d):
    return _langs(s, d).where("sl is not null and tl is not null").groupBy("sl", "tl").agg(F.count("*").alias("files"), F.min("file_id").alias("first_file"))


def encoding_names(s, d):
    p = table(s, d, "convert_params").dropDuplicates(["file_id"])
    bare = F.regexp_replace(F.upper("src_encoding"), "[^A-Z0-9]", "")
    name = F.when(bare == "UTF8", "UTF-8").when(bare.isin("CP1252", "WINDOWS1252"), "windows-1252").when(bare.isin("LATIN1", "ISO88591"), "ISO-8859-1").when(F.col("src_encoding").isNull(), "(none)").otherwise(F.upper("src_encoding"))
    return p.groupBy(name.alias("encoding")).agg(F.count("*").alias("files"))


def target_names(s, d):
    f = table(s, d, "files").where("target_language is not null")
    return f.select("file_id", assemble.target_name(F.col("original"), T.clean_tag("target_language")).alias("target_file"))


def originals_without_params(s, d):
    """Originals of documents that no file with parameters has."""
    f, p = table(s, d, "files"), table(s, d, "convert_params")
    return _docs(s, d).select("original").where("original is not null").distinct().exceptAll(f.join(p.select("file_id").distinct(), "file_id", "left_semi").select("original").distinct())


def shared_sources(s, d):
    """Sources of units that are also offered as matches, with the number of units."""
    offered = table(s, d, "alt_trans").select("source").where("source is not null").distinct()
    return units(s, d, "source").join(offered, "source", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


def revenue_rollup(s, d):
    l = table(s, d, "lineitem")
    money = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return l.rollup("l_returnflag", "l_linestatus").agg(money.alias("revenue"), F.count("*").alias("n"))


def p3_found(s, d):
    return nested.found(table(s, d, "xliff_records"))


def p3_files(s, d):
    return nested.flat_table(table(s, d, "xliff_records"), "file")


def p3_groups(s, d):
    return nested.flat_table(table(s, d, "xliff_records"), "group")


def p3_units(s, d):
    return nested.flat_table(table(s, d, "xliff_records"), "unit")


def p3_targets(s, d):
    return nested.flat_table(table(s, d, "xliff_records"), "target")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        repetition_classify, word_bands, word_vector, status_by_segments, status_by_words, status_by_chars, word_count_by_lang, word_count_cjk, char_space_stats, match_bands, best_match,
        ice_match, ice_lines, ice_applied, ice_lines_applied, file_match_first, skeleton_merge, segment_lite, paragraph_split, normalise_space, format_detect, pseudo_translate, copy_sources, approve_all, remove_targets, convert_state, tmx_export,
        join_documents, split_by_original, common_path_root, compare_documents, duplicate_ids, dangling_refs, pair_balance, date_check, language_check, attribute_whitelist, violations_report, json_leaves,
        subtitle_parse, po_parse, properties_parse, status_history, status_codec, status_bars, merge_adjacent, renumber_ids, slide_sort, tag_multiset_diff, inherit_translate, filter_values, key_scope_resolve,
        unit_regroup, metadata_pivot, language_directions, encoding_names, target_names, originals_without_params, shared_sources, revenue_rollup, p3_found, p3_files, p3_groups, p3_units, p3_targets,
    ]
    return {f.__name__: f for f in named} | formats.queries() | inline.queries() | checks.queries() | segmentation.queries() | packages.queries()
