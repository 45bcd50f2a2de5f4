"""Documents in JSON as a table of elements and attributes, and rules of the public standards as data over it.

One row for each attribute of each element, and one with an empty attribute for the element itself. Rules say which
attributes an element must have, what values they may have, what must be unique and what must refer to something. A rule is a
row of a small table; violations come from one scan of the elements: the rows that no rule is about never leave it.

Defined results: documents that are null or don't parse have no elements. A version other than 1.x and 2.x has no rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.operators.jsonnodes import OPEN_A, OPEN_O, Nodes

SCHEMA = "rec_id bigint, version string, scope bigint, node bigint, element string, attribute string, value string"
#: Documents whose bytes are looked at together; memory only.
CHUNK = 1024


def elements_of(ids: pa.Array, payloads: pa.Array) -> pa.RecordBatch:
    tree = Nodes(payloads)
    n = len(tree.kind)
    names = np.array([*[k for k, _ in sorted(tree.names.items(), key=lambda x: x[1])], ""], object)
    # an object's name is its own or, in a list, the list's
    up = np.where(tree.key < 0, np.maximum(tree.parent, 0), np.arange(n))
    name = names[np.where(tree.parent < 0, -1, tree.key[up])] if n else np.zeros(0, object)
    text = tree.text[tree.token] if n else np.zeros(0, np.int64)
    sound = tree.root[text] >= 0
    objects = np.flatnonzero((tree.kind == OPEN_O) & sound & (name != ""))
    leaf = (tree.kind != OPEN_O) & (tree.kind != OPEN_A) & sound & (tree.key >= 0)
    values = tree.strings(np.arange(n))
    has = values.is_valid().to_numpy(zero_copy_only=False)
    leaves = np.flatnonzero(leaf & has)
    leaves = leaves[name[tree.parent[leaves]] != ""]
    place = np.arange(n) - (np.searchsorted(text, np.arange(len(payloads)))[text] if n else 0)
    # the file that holds a node, however deep; -1 outside of files and for these themselves
    files = tree.is_object(np.arange(n)) & (name == "file")
    scope, walk = np.full(n, -1, np.int64), tree.parent.copy()
    while (walk >= 0).any():
        at = np.maximum(walk, 0)
        hit = (walk >= 0) & files[at]
        scope[hit] = place[walk[hit]]
        walk = np.where(hit | (walk < 0), -1, tree.parent[at])
    wrapped = tree.child(tree.root, "xliff")
    version = tree.strings(tree.child(np.where(wrapped >= 0, wrapped, tree.root), "version"))
    node = np.concatenate([objects, tree.parent[leaves]])
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(text[node])), version.take(pa.array(text[node])), pa.array(scope[node]), pa.array(place[node]), pa.array(name[node], pa.string()),
            pa.array(np.concatenate([np.full(len(objects), "", object), name[leaves]]), pa.string()), pa.concat_arrays([pa.nulls(len(objects), pa.string()), values.take(pa.array(leaves))]),
        ],
        names=["rec_id", "version", "scope", "node", "element", "attribute", "value"],
    )


def elements(df: DataFrame, key: str = "rec_id", payload: str = "payload") -> DataFrame:
    """``rec_id, version, scope, node, element, attribute, value``; ``node`` numbers the values of a document in order, ``scope`` is
    the file that holds it."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                yield elements_of(part.column(0), part.column(1))

    return df.select(F.col(key).cast("bigint"), F.col(payload).cast("string")).where(F.col(payload).isNotNull()).mapInArrow(run, SCHEMA)


@dataclass(frozen=True)
class Rule:
    """``kind``: required, pattern (of the whole value), unique (in its file) or reference (to an ``id`` of the elements ``value``)."""

    rule_id: str
    version: str
    element: str
    attribute: str
    kind: str
    value: str = ""


# Patterns of attribute values of the public standards.
_YES, _ID, _LANG, _SPACE, _NUMBER = "yes|no", "[^ \\t\\n]+", "[A-Za-z]{2,8}(?:[-_][A-Za-z0-9]{1,8})*", "default|preserve", "[0-9]+(?:\\.[0-9]+)?%?"
_QUALITY, _PRIORITY, _DATE = "(?:100|[0-9]{1,2})(?:\\.[0-9]+)?", "10|[1-9]", "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z"
_STATES_1 = "final|needs-adaptation|needs-l10n|needs-review-adaptation|needs-review-l10n|needs-review-translation|needs-translation|new|signed-off|translated|x-.+"
_QUALIFIERS = "exact-match|fuzzy-match|id-match|leveraged-glossary|leveraged-inherited|leveraged-mt|leveraged-repository|leveraged-tm|mt-suggestion|rejected-grammar|rejected-inaccurate|rejected-length|rejected-spelling|tm-suggestion|x-.+"
_DIR, _STATES_2, _MATCH, _ORDER = "ltr|rtl|auto", "initial|translated|reviewed|final", "am|mt|icm|idm|tb|tm|other", "yes|firstNo|no"
_1 = [
    ("file", "original", "required", ""), ("file", "source-language", "required", ""), ("file", "datatype", "required", ""), ("file", "source-language", "pattern", _LANG), ("file", "target-language", "pattern", _LANG), ("file", "date", "pattern", _DATE), ("file", "xml:space", "pattern", _SPACE), ("file", "original", "unique", ""),
    ("trans-unit", "id", "required", ""), ("trans-unit", "source", "required", ""), ("trans-unit", "id", "unique", ""), ("trans-unit", "id", "pattern", _ID), ("trans-unit", "approved", "pattern", _YES), ("trans-unit", "translate", "pattern", _YES), ("trans-unit", "reformat", "pattern", _YES), ("trans-unit", "xml:space", "pattern", _SPACE), ("trans-unit", "maxwidth", "pattern", _NUMBER), ("trans-unit", "phase-name", "reference", "phase"),
    ("group", "id", "required", ""), ("group", "id", "unique", ""), ("group", "resname", "required", ""), ("group", "translate", "pattern", _YES), ("group", "merge-trans", "pattern", _YES), ("target", "state", "pattern", _STATES_1), ("target", "state-qualifier", "pattern", _QUALIFIERS), ("target", "xml:lang", "pattern", _LANG), ("source", "xml:lang", "pattern", _LANG),
    ("alt-trans", "match-quality", "pattern", _QUALITY), ("alt-trans", "match-quality", "required", ""), ("alt-trans", "target", "required", ""), ("alt-trans", "alttranstype", "pattern", "proposal|previous-version|rejected|reference|accepted"), ("note", "priority", "pattern", _PRIORITY), ("note", "annotates", "pattern", "source|target|general"), ("note", "xml:lang", "pattern", _LANG),
    ("phase", "phase-name", "required", ""), ("phase", "process-name", "required", ""), ("phase", "date", "pattern", _DATE), ("tool", "tool-id", "required", ""), ("tool", "tool-name", "required", ""), ("tool", "tool-id", "unique", ""), ("external-file", "href", "required", ""), ("internal-file", "form", "required", ""), ("bin-unit", "id", "required", ""), ("bin-unit", "mime-type", "required", ""), ("ph", "id", "required", ""), ("x", "id", "required", ""), ("g", "id", "required", ""), ("bx", "id", "required", ""), ("ex", "id", "required", ""), ("mrk", "mtype", "required", ""), ("it", "pos", "pattern", "open|close"),
]
_2 = [
    ("xliff", "version", "pattern", "2\\.[012]"), ("xliff", "srcLang", "required", ""), ("xliff", "srcLang", "pattern", _LANG), ("xliff", "trgLang", "pattern", _LANG), ("xliff", "trgLang", "required", ""), ("file", "id", "required", ""), ("file", "id", "unique", ""), ("file", "original", "required", ""), ("file", "original", "unique", ""), ("file", "canResegment", "pattern", _YES), ("file", "translate", "pattern", _YES), ("file", "srcDir", "pattern", _DIR), ("file", "trgDir", "pattern", _DIR),
    ("group", "id", "required", ""), ("group", "id", "unique", ""), ("group", "name", "required", ""), ("group", "canResegment", "pattern", _YES), ("group", "translate", "pattern", _YES), ("unit", "id", "required", ""), ("unit", "id", "unique", ""), ("unit", "id", "pattern", _ID), ("unit", "name", "required", ""), ("unit", "translate", "pattern", _YES), ("unit", "canResegment", "pattern", _YES), ("unit", "srcDir", "pattern", _DIR), ("unit", "trgDir", "pattern", _DIR), ("unit", "xml:space", "pattern", _SPACE),
    ("segment", "source", "required", ""), ("segment", "id", "required", ""), ("segment", "state", "pattern", _STATES_2), ("segment", "canResegment", "pattern", _YES), ("segment", "state", "required", ""), ("target", "state", "pattern", _STATES_2), ("target", "xml:lang", "pattern", _LANG), ("target", "order", "pattern", "[1-9][0-9]*"), ("matches", "matchQuality", "pattern", _QUALITY), ("matches", "similarity", "pattern", _QUALITY), ("matches", "source", "required", ""), ("matches", "target", "required", ""), ("matches", "type", "pattern", _MATCH), ("matches", "ref", "reference", "segment"),
    ("note", "priority", "pattern", _PRIORITY), ("note", "appliesTo", "pattern", "source|target"), ("metadata", "category", "required", ""), ("meta", "type", "required", ""), ("meta", "value", "required", ""), ("ph", "id", "required", ""), ("pc", "id", "required", ""), ("sc", "id", "required", ""), ("ph", "canCopy", "pattern", _YES), ("ph", "canDelete", "pattern", _YES), ("ph", "canReorder", "pattern", _ORDER), ("pc", "canOverlap", "pattern", _YES), ("ph", "dataRef", "reference", "data"), ("ec", "startRef", "reference", "sc"), ("data", "id", "required", ""), ("data", "id", "unique", ""), ("cp", "hex", "pattern", "[0-9A-F]{4,6}"), ("mrk", "id", "required", ""), ("mrk", "type", "pattern", "generic|comment|term|[^:]+:.+"), ("mrk", "translate", "pattern", _YES),
]
RULES = [Rule(f"v{v}-{e}-{a}-{k}", v, e, a, k, x) for v, rules in (("1", _1), ("2", _2)) for e, a, k, x in rules]


def violations(table: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``rule_id, rec_id, node, detail`` of a table of elements. Patterns need no shuffle; presence, uniqueness and references
    need one grouping by document each."""
    of = table.withColumn("v", F.substring("version", 1, 1))
    key = F.concat_ws("-", F.concat(F.lit("v"), "v"), "element", "attribute")
    named = {kind: [r for r in rules if r.kind == kind] for kind in ("required", "pattern", "unique", "reference")}
    found = []
    if named["pattern"]:
        table_ = F.create_map(*[F.lit(x) for r in named["pattern"] for x in (f"v{r.version}-{r.element}-{r.attribute}", f"^(?:{r.value})\\z")])
        found.append(of.withColumn("pattern", table_[key]).where("pattern is not null and not value rlike pattern").select(F.concat(key, F.lit("-pattern")).alias("rule_id"), "rec_id", "node", F.col("value").alias("detail")))
    if named["required"]:
        wanted: dict[str, list[str]] = {}
        for r in named["required"]:
            wanted.setdefault(f"v{r.version}-{r.element}", []).append(r.attribute)
        pairs = [x for k, names in wanted.items() for x in (F.lit(k), F.array(*map(F.lit, names)))]
        element = F.concat(F.lit("v"), "v", F.lit("-"), "element")
        mine = of.withColumn("wanted", F.create_map(*pairs)[element]).where("wanted is not null").groupBy("rec_id", "node", "v", "element").agg(F.first("wanted").alias("wanted"), F.collect_set("attribute").alias("has"))
        # a source or target may be an element of its own instead of an attribute
        missing = mine.select("rec_id", "node", "v", "element", F.explode(F.array_except("wanted", "has")).alias("attribute"))
        children = of.where("attribute = '' and element in ('source', 'target')").select("rec_id", F.col("element").alias("attribute")).distinct()
        inner = missing.join(children.withColumn("there", F.lit(True)), ["rec_id", "attribute"], "left").where("there is null")
        found.append(inner.select(F.concat(key, F.lit("-required")).alias("rule_id"), "rec_id", "node", F.col("attribute").alias("detail")))
    if named["unique"]:
        names = [f"v{r.version}-{r.element}-{r.attribute}" for r in named["unique"]]
        twice = of.where(key.isin(names)).groupBy("rec_id", "scope", key.alias("k"), "value").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n > 1")
        found.append(twice.select(F.concat("k", F.lit("-unique")).alias("rule_id"), "rec_id", "node", F.col("value").alias("detail")))
    if named["reference"]:
        target = F.create_map(*[F.lit(x) for r in named["reference"] for x in (f"v{r.version}-{r.element}-{r.attribute}", r.value)])
        refs = of.withColumn("target", target[key]).where("target is not null").select("rec_id", "node", key.alias("k"), "target", F.regexp_replace("value", "^.*[#/]", "").alias("value"), F.col("value").alias("detail"))
        ids = of.where("attribute in ('id', 'phase-name')").select("rec_id", F.col("element").alias("target"), "value").distinct()
        found.append(refs.join(ids, ["rec_id", "target", "value"], "left_anti").select(F.concat("k", F.lit("-reference")).alias("rule_id"), "rec_id", "node", "detail"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def rule_value(rules: list[Rule], kind: str) -> dict[str, str]:
    return {f"v{r.version}-{r.element}-{r.attribute}": r.value for r in rules if r.kind == kind}


def xliff_languages(table: DataFrame) -> DataFrame:
    """``rec_id, source, target``: languages of a document of any version."""
    pick = lambda a, b: F.min(F.when((F.col("attribute") == a) & F.col("element").isin("file", "xliff"), F.col("value")).when((F.col("attribute") == b) & (F.col("element") == "xliff"), F.col("value")))
    return table.groupBy("rec_id").agg(pick("source-language", "srcLang").alias("source"), pick("target-language", "trgLang").alias("target"))

