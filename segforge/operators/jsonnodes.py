"""JSON texts of a whole Arrow column as one table of nodes, by array operations on the column's buffers.

Quotes, brackets and atoms are found over all bytes at once; depth is a running sum, a node's parent the last bracket
opened one level up. Nothing is parsed text by text: only strings with escapes are decoded, all in one call. Texts that break the
grammar are not ``valid``; any depth is allowed.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OPEN_O, CLOSE_O, OPEN_A, CLOSE_A, COLON, COMMA, KEY, STRING, ATOM, START = range(10)
_STRUCTURE = np.full(256, -1, np.int8)
for _c, _t in zip(b"{}[]:,", range(6)):
    _STRUCTURE[_c] = _t
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_VALUE = [OPEN_O, OPEN_A, STRING, ATOM]
#: Which token may follow which.
_NEXT = np.zeros((10, 10), bool)
_NEXT[START, _VALUE] = _NEXT[COLON, _VALUE] = _NEXT[OPEN_A, _VALUE] = _NEXT[COMMA, _VALUE] = True
_NEXT[OPEN_O, [KEY, CLOSE_O]] = _NEXT[KEY, COLON] = _NEXT[OPEN_A, CLOSE_A] = _NEXT[COMMA, KEY] = True
for _t in (CLOSE_O, CLOSE_A, STRING, ATOM):
    _NEXT[_t, [COMMA, CLOSE_O, CLOSE_A]] = True
_NUMBER = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


def _decoded(raw: list[bytes]) -> list[str | None]:
    """Strings with escapes, without their quotes; None where one is broken."""
    texts = [x.decode("utf-8", "replace") for x in raw]
    try:
        got = json.loads('["' + '","'.join(texts) + '"]')
        if len(got) == len(texts):
            return got
    except ValueError:
        pass
    out = []
    for t in texts:
        try:
            out.append(json.loads(f'"{t}"'))
        except ValueError:
            out.append(None)
    return out


class Nodes:
    """All values of a column of JSON texts in order of place. ``kind``: OPEN_O, OPEN_A, STRING or ATOM; ``parent``: the
    holding object or list, -1 for a root; ``key``: number of the name, -1 in lists; ``root``: each text's root, -1 if not valid."""

    def __init__(self, texts: pa.Array):
        self.texts = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        self.bytes = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]
        self._tokens()
        self._check()
        self._nodes()

    def _tokens(self) -> None:
        b, bounds = self.bytes, self.bounds
        quote = np.flatnonzero(b == 34)
        slash = np.flatnonzero(b == 92)
        if len(slash) and len(quote):
            # a quote after an odd run of backslashes is escaped
            first = np.concatenate([[True], np.diff(slash) != 1])
            run = np.arange(len(slash)) - np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0)) + 1
            at = np.searchsorted(slash, quote - 1)
            before = (at < len(slash)) & (slash[np.minimum(at, len(slash) - 1)] == quote - 1)
            quote = quote[~(before & (run[np.minimum(at, len(slash) - 1)] % 2 == 1))]
        self.slash = slash
        owner = np.searchsorted(bounds, quote, side="right") - 1
        nth = np.arange(len(quote)) - np.searchsorted(quote, bounds[:-1])[owner] if len(quote) else np.zeros(0, np.int64)
        counts = np.bincount(owner, minlength=self.texts)
        self.valid = counts % 2 == 0
        pairs = self.valid[owner]
        starts, stops = quote[pairs & (nth % 2 == 0)], quote[pairs & (nth % 2 == 1)]
        depth = np.zeros(len(b) + 1, np.int8)
        depth[starts] += 1
        depth[stops + 1] -= 1  # where the next text begins with a string, both meet
        inside = np.cumsum(depth[:-1], dtype=np.int8) > 0
        control = np.flatnonzero(inside & (b < 32))
        self.valid[np.searchsorted(bounds, control, side="right") - 1] = False
        kind = np.where(inside, np.int8(-1), _STRUCTURE[b])
        marks = np.flatnonzero(kind >= 0)
        other = ~inside & (kind < 0) & ~_BLANK[b]
        edge = np.diff(np.concatenate([[False], other, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cut = np.setdiff1d(bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(b))], begin)
        cut = cut[other[cut] & other[cut - 1]]  # an atom that ends one text and begins the next
        begin, end = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))
        at = np.concatenate([marks, starts, begin])
        order = np.argsort(at, kind="stable")
        self.at = at[order]
        self.end = np.concatenate([marks + 1, stops, end])[order]
        self.role = np.concatenate([kind[marks], np.full(len(starts), STRING, np.int8), np.full(len(begin), ATOM, np.int8)])[order]
        self.text = np.searchsorted(bounds, self.at, side="right") - 1

    def _check(self) -> None:
        role, n = self.role, len(self.role)
        opens = (role == OPEN_O) | (role == OPEN_A)
        closes = (role == CLOSE_O) | (role == CLOSE_A)
        step = np.cumsum(opens.astype(np.int64) - closes)
        first = np.searchsorted(self.text, np.arange(self.texts + 1))
        base = np.concatenate([[0], step])[first[:-1]]
        depth = step - base[self.text] if n else step
        around = depth - opens + closes * 1  # depth of the brackets that hold the token; a closing one belongs to those it closes
        self.valid &= first[1:] > first[:-1]
        self.valid[np.unique(self.text[depth < 0])] = False
        self.valid &= np.concatenate([[0], step])[first[1:]] == base
        where = np.flatnonzero(opens)
        far = len(self.bytes) + 1
        level = np.maximum(depth[where], 0) * far + self.at[where]
        order = np.argsort(level)
        got = np.searchsorted(level[order], np.maximum(around, 0) * far + self.at) - 1
        holder = np.where((around > 0) & (got >= 0), where[order][np.maximum(got, 0)] if len(where) else -1, -1)
        in_object = (holder >= 0) & (role[np.maximum(holder, 0)] == OPEN_O) if n else np.zeros(0, bool)
        before = np.concatenate([[START], role[:-1]]).astype(np.int8) if n else role
        before[first[:-1][first[1:] > first[:-1]]] = START
        role = role.copy()
        role[(role == STRING) & in_object & ((before == OPEN_O) | (before == COMMA))] = KEY
        before = np.concatenate([[START], role[:-1]]).astype(np.int8) if n else role
        before[first[:-1][first[1:] > first[:-1]]] = START
        fine = _NEXT[before, role]
        fine &= ~closes | np.where(role == CLOSE_O, in_object, ~in_object & (holder >= 0))
        fine &= (role != COMMA) | (holder >= 0)
        fine &= (role != KEY) | in_object
        fine &= ~(in_object & (before == COMMA)) | (role == KEY)
        fine &= (before == START) | (holder >= 0)
        self.valid[np.unique(self.text[~fine])] = False
        self.role, self.holder = role, holder
        atoms = np.flatnonzero(role == ATOM)
        raw = self.bytes.tobytes()
        known: dict[bytes, bool] = {}
        self.is_number = np.zeros(n, bool)
        for i, a, z in zip(atoms.tolist(), self.at[atoms].tolist(), self.end[atoms].tolist()):
            word = raw[a:z]
            got = known.get(word)
            if got is None:
                got = known[word] = bool(_NUMBER.fullmatch(word))
            if got:
                self.is_number[i] = True
            elif word not in (b"true", b"false", b"null"):
                self.valid[self.text[i]] = False
        # strings with escapes
        strings = np.flatnonzero((role == STRING) | (role == KEY))
        held = np.searchsorted(self.slash, self.at[strings]) < np.searchsorted(self.slash, self.end[strings])
        escaped = strings[held].tolist()
        self.unescaped = dict(zip(escaped, _decoded([raw[self.at[i] + 1 : self.end[i]] for i in escaped]))) if escaped else {}
        self.has_escapes = np.zeros(n, bool)
        self.has_escapes[escaped] = True
        for i, t in self.unescaped.items():
            if t is None:
                self.valid[self.text[i]] = False

    def _nodes(self) -> None:
        role = self.role
        values = np.flatnonzero((role == OPEN_O) | (role == OPEN_A) | (role == STRING) | (role == ATOM))
        number = np.full(len(role) + 1, -1, np.int64)
        number[values] = np.arange(len(values))
        self.token, self.kind = values, role[values]
        self.parent = number[self.holder[values]]
        keys = np.flatnonzero(role == KEY)
        named = (self.parent >= 0) & (self.kind[np.maximum(self.parent, 0)] == OPEN_O) if len(values) else np.zeros(0, bool)
        coded = self._strings(keys).dictionary_encode()
        code = np.full(len(role) + 1, -1, np.int64)
        code[keys] = coded.indices.to_numpy()
        self.names = {name: i for i, name in enumerate(coded.dictionary.to_pylist())}
        self.key = np.where(named, code[np.maximum(values - 2, 0)], -1)
        self.by_name: dict[int, np.ndarray] = {}
        self.objects, self.lists = np.append(self.kind == OPEN_O, False), np.append(self.kind == OPEN_A, False)  # -1 is neither
        # members of each node: a list column's offsets and values
        self.by_parent = np.argsort(self.parent, kind="stable")
        self.first = np.searchsorted(self.parent[self.by_parent], np.arange(len(values) + 1))
        self.root = np.full(self.texts, -1, np.int64)
        tops = np.flatnonzero(self.parent < 0)
        self.root[self.text[values[tops]]] = tops
        self.root[~self.valid] = -1

    def _strings(self, tokens: np.ndarray) -> pa.Array:
        """Text of string tokens, and of atoms as they are written."""
        quoted = (self.role[tokens] != ATOM).astype(np.int64)
        start, size = self.at[tokens] + quoted, self.end[tokens] - self.at[tokens] - quoted
        ends = np.zeros(len(tokens) + 1, np.int32)
        np.cumsum(size, out=ends[1:])
        index = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
        got = pa.StringArray.from_buffers(len(tokens), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.bytes[index])))
        if not self.unescaped:
            return got
        changed = np.flatnonzero(self.has_escapes[tokens])
        if not len(changed):
            return got
        values = pa.array([self.unescaped[int(tokens[i])] or "" for i in changed], pa.string())
        take = np.arange(len(tokens))
        take[changed] = len(tokens) + np.arange(len(changed))
        return pa.concat_arrays([got, values]).take(pa.array(take))

    def child(self, nodes: np.ndarray, name: str) -> np.ndarray:
        """Member of each node by name, -1 if there is none; the last of equal names counts."""
        code = self.names.get(name)
        if code is None or not len(nodes):
            return np.full(len(nodes), -1, np.int64)
        of = self.by_name.get(code)
        if of is None:
            held = np.flatnonzero(self.key == code)
            of = self.by_name[code] = np.full(len(self.kind) + 1, -1, np.int64)
            of[self.parent[held]] = held
        return of[nodes]

    def is_object(self, nodes: np.ndarray) -> np.ndarray:
        return self.objects[nodes]

    def is_list(self, nodes: np.ndarray) -> np.ndarray:
        return self.lists[nodes]

    def members(self, nodes: np.ndarray) -> pa.ListArray:
        """Members of lists as a list column; an object stands for a list of one; anything else has none."""
        one, many = self.is_object(nodes), self.is_list(nodes)
        safe = np.maximum(nodes, 0)
        begin = np.where(many, self.first[safe] if len(self.kind) else 0, 0)
        size = np.where(many, self.first[safe + 1] - begin if len(self.kind) else 0, one.astype(np.int64))
        ends = np.zeros(len(nodes) + 1, np.int32)
        np.cumsum(size, out=ends[1:])
        place = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
        single = np.repeat(one, size)
        held = self.by_parent[np.where(single, 0, np.repeat(begin, size) + place)] if ends[-1] else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.where(single, np.repeat(nodes, size), held)))

    def strings(self, nodes: np.ndarray, numbers: bool = True) -> pa.Array:
        """Text of strings (and numbers as they are written), null for anything else."""
        safe = np.maximum(nodes, 0)
        fits = np.zeros(len(nodes), bool)
        if len(self.kind):
            fits = (nodes >= 0) & ((self.kind[safe] == STRING) | (numbers & self.is_number[self.token[safe]]))
        got = self._strings(self.token[nodes[fits]])
        take = np.full(len(nodes), -1, np.int64)
        take[fits] = np.arange(int(fits.sum()))
        return got.take(pa.array(take, mask=~fits))

    def joined_text(self, nodes: np.ndarray, names: tuple[str, ...]) -> pa.Array:
        """Text of each node: a string, the first named member of an object that isn't null, or the pieces of a list in order."""
        owner, now = np.flatnonzero(nodes >= 0), nodes[nodes >= 0]
        while True:
            objects, lists = self.is_object(now), self.is_list(now)
            if not (objects.any() or lists.any()):
                break
            chosen = np.full(len(now), -1, np.int64)
            for name in names:
                got = self.child(now, name)
                open_ = objects & (chosen < 0) & (got >= 0) & ~self._null(got)
                chosen[open_] = got[open_]
            stay = np.where(objects, chosen, now)
            ends = np.zeros(len(now) + 1, np.int64)
            begin = np.where(lists, self.first[now], 0)
            size = np.where(lists, self.first[now + 1] - begin, (stay >= 0).astype(np.int64))
            np.cumsum(size, out=ends[1:])
            place = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
            listed = np.repeat(lists, size)
            now = np.where(listed, self.by_parent[np.where(listed, np.repeat(begin, size) + place, 0)], np.repeat(stay, size))
            owner = np.repeat(owner, size)
        text = self.strings(now)
        keep = text.is_valid().to_numpy(zero_copy_only=False)
        text, owner = text.filter(pa.array(keep)), owner[keep]
        ends = np.searchsorted(owner, np.arange(len(nodes) + 1)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), text), "")

    def _null(self, nodes: np.ndarray) -> np.ndarray:
        tokens = self.token[np.maximum(nodes, 0)]
        return (nodes >= 0) & (self.role[tokens] == ATOM) & (self.bytes[self.at[tokens]] == ord("n"))
