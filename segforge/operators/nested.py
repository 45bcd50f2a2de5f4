"""Deeply nested records to flat tables that keep parent keys.

The payloads of a batch become one table of nodes by array operations on the column's bytes (``jsonnodes``); everything
after that works level by level on Arrow buffers. A level is a list column: its offsets give each child's parent index
(``list_parent_indices``), and the parents' keys reach the children by one vectorised ``take``. Groups nest to any depth: the
frontier of groups is expanded until it is empty, so neither the schema nor the code fixes a depth.

Defined results: a payload that is null, cut off, no JSON object or without a file list gives no rows. A list of one
may stand as its only member. A missing or null id or original is ''. Ids that are numbers keep their notation.
Repeated payloads under other ids give their own rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segforge.operators.jsonnodes import Nodes

#: The one schema all tables share, so that a single pass over the payloads can give any of them.
SCHEMA = (
    "kind string, rec_id bigint, file_no bigint, version string, original string, datatype string, group_id string, "
    "parent_group string, depth int, unit_id string, place string, target_no bigint, quality string, source string, target string"
)
TABLES = {
    "file": ["rec_id", "file_no", "version", "original", "datatype"],
    "group": ["rec_id", "file_no", "original", "group_id", "parent_group", "depth"],
    "unit": ["rec_id", "file_no", "original", "group_id", "unit_id"],
    "target": ["rec_id", "file_no", "original", "group_id", "unit_id", "place", "target_no", "quality", "source", "target"],
}
_TYPES = {"rec_id": pa.int64(), "file_no": pa.int64(), "depth": pa.int32(), "target_no": pa.int64()}
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Payloads whose bytes are looked at together; memory only.
CHUNK = 1024
_TEXT = ("value", "#text", "text", "content")


class Level:
    """Nodes of one level with their keys as Arrow columns."""

    def __init__(self, tree: Nodes, nodes: np.ndarray, keys: dict[str, pa.Array]):
        self.tree, self.nodes, self.keys = tree, nodes, keys

    def child(self, *names: str) -> np.ndarray:
        """The first of the named members that there is; -1 if there is none."""
        got = self.tree.child(self.nodes, names[0])
        for name in names[1:]:
            got = np.where(got >= 0, got, self.tree.child(self.nodes, name))
        return got

    def children(self, *lists: np.ndarray, numbered: str | None = None) -> "Level":
        """Objects in the given lists of each node, one list after the other; the list column's parent indices carry the
        parents' keys to them by take. ``numbered`` gets the place in the lists."""
        nodes, parents, places = [], [], []
        base = np.zeros(len(self.nodes), np.int64)
        for held in lists:
            column = self.tree.members(held)
            parent = pc.list_parent_indices(column).to_numpy()
            ends = column.offsets.to_numpy()
            nodes.append(column.values.to_numpy())
            parents.append(parent)
            places.append(np.arange(len(parent)) - ends[:-1][parent] + base[parent])
            base = base + np.diff(ends)
        node, parent, place = (np.concatenate(x) for x in (nodes, parents, places))
        keep = self.tree.is_object(node)
        take = pa.array(parent[keep])
        keys = {name: values.take(take) for name, values in self.keys.items()}
        if numbered:
            keys[numbered] = pa.array(place[keep])
        return Level(self.tree, node[keep], keys)

    def where(self, keep: np.ndarray) -> "Level":
        chosen = pa.array(keep)
        return Level(self.tree, self.nodes[keep], {k: v.filter(chosen) for k, v in self.keys.items()})

    def put(self, name: str, values: pa.Array) -> "Level":
        self.keys[name] = values
        return self

    def ident(self, *names: str) -> pa.Array:
        """A string, or a number as it is written; '' for anything else."""
        return self.tree.strings(self.child(*names)).fill_null("")

    def rows(self, kind: str, wanted: list[str]) -> pa.RecordBatch:
        n = len(self.nodes)
        columns = [pa.array([kind]).take(pa.array(np.zeros(n, np.int64))) if c == "kind" else self.keys[c] if c in wanted else pa.nulls(n, _TYPES.get(c, pa.string())) for c in _COLUMNS]
        return pa.RecordBatch.from_arrays(columns, names=_COLUMNS)


def _same(value, n: int, of: pa.DataType) -> pa.Array:
    return pa.array([value], of).take(pa.array(np.zeros(n, np.int64)))


def _datatypes(files: Level) -> pa.Array:
    """``datatype`` of 1.2 files; 2.x files carry it as metadata, of which the first counts."""
    own = files.tree.strings(files.child("datatype"))
    at = Level(files.tree, files.nodes, {"at": pa.array(np.arange(len(files.nodes)))})
    blocks = at.children(at.child("metadata"))
    metas = blocks.children(blocks.child("meta"))
    value = metas.tree.strings(metas.child("value"))
    fits = pc.and_(pc.equal(metas.ident("type"), "datatype"), value.is_valid())
    found, first = np.unique(metas.keys["at"].filter(fits).to_numpy(), return_index=True)
    take = np.full(len(files.nodes), -1, np.int64)
    take[found] = first
    return pc.coalesce(own, value.filter(fits).take(pa.array(take, mask=take < 0)))


def flatten_batch(ids: pa.Array, payloads: pa.Array, kinds: set[str]) -> Iterator[pa.RecordBatch]:
    """All wanted tables of one batch of payloads."""
    tree = Nodes(payloads)
    wrapped = tree.child(tree.root, "xliff")
    root = np.where(tree.is_object(tree.root), np.where(wrapped >= 0, wrapped, tree.root), -1)
    records = Level(tree, root, {"rec_id": ids}).where(tree.is_object(root))
    records.put("version", records.ident("version"))
    files = records.children(records.child("file"), numbered="file_no")
    n = len(files.nodes)
    files.put("original", files.ident("original")).put("datatype", _datatypes(files))
    if "file" in kinds:
        yield files.rows("file", TABLES["file"])
    files.put("group_id", _same("", n, pa.string())).put("depth", _same(0, n, pa.int32()))
    body = files.child("body")
    frontier, body = files, np.where(tree.is_object(body), body, -1)
    while len(frontier.nodes):
        inner = Level(tree, body, frontier.keys)
        member = lambda name: np.where(inner.child(name) >= 0, inner.child(name), frontier.child(name))  # noqa: B023, E731
        units = frontier.children(member("trans-unit"), member("unit"))
        units.put("unit_id", units.ident("id"))
        if "unit" in kinds:
            yield units.rows("unit", TABLES["unit"])
        if "target" in kinds:
            yield from _targets(units)
        groups = frontier.children(member("group"))
        groups.keys["parent_group"] = groups.keys["group_id"]
        groups.put("group_id", groups.ident("id"))
        groups.keys["depth"] = pc.add(groups.keys["depth"], pa.scalar(1, pa.int32()))
        if "group" in kinds:
            yield groups.rows("group", TABLES["group"])
        frontier, body = groups, np.full(len(groups.nodes), -1, np.int64)


def _targets(units: Level) -> Iterator[pa.RecordBatch]:
    own = units.where(units.child("segment") < 0)
    own.put("target_no", _same(0, len(own.nodes), pa.int64()))
    held = units.child("matches")
    inner = np.where(units.tree.is_object(held), units.tree.child(np.where(units.tree.is_object(held), held, -1), "match"), -1)
    matches = units.children(units.child("alt-trans"), np.where(inner >= 0, inner, held), numbered="target_no")
    for level, place in ((own, "unit"), (units.children(units.child("segment"), numbered="target_no"), "unit"), (matches, "match")):
        n = len(level.nodes)
        texts = level.tree.joined_text(level.child("target"), _TEXT)
        quality = level.ident("match-quality", "matchQuality")
        level.put("target", texts).put("source", level.tree.joined_text(level.child("source"), _TEXT)).put("place", _same(place, n, pa.string()))
        level.put("quality", pc.if_else(pc.equal(quality, ""), pa.scalar(None, pa.string()), quality))
        yield level.where(pc.not_equal(pc.utf8_trim_whitespace(texts), "").to_numpy(zero_copy_only=False)).rows("target", TABLES["target"])


def flatten(df: DataFrame, kinds: set[str] | None = None, key: str = "rec_id", payload: str = "payload") -> DataFrame:
    """Tagged rows of all wanted tables in one pass; the column ``kind`` says to which table a row belongs."""
    wanted = set(kinds or TABLES)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                yield from flatten_batch(part.column(0), part.column(1), wanted)

    return df.select(F.col(key).cast("bigint"), F.col(payload).cast("string")).where(F.col(payload).isNotNull()).mapInArrow(run, SCHEMA)


def flat_table(df: DataFrame, kind: str, **names: str) -> DataFrame:
    """One of the tables file, group, unit and target."""
    return flatten(df, {kind}, **names).select(*TABLES[kind])


def found(df: DataFrame) -> DataFrame:
    """Targets with text, as the project's data asks for them."""
    return flat_table(df, "target").select("rec_id", "file_no", "original", "group_id", "unit_id", "place", "target_no")
