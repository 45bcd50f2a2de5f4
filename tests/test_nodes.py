"""The node table of JSON texts against the standard parser."""

import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segforge.operators.jsonnodes import OPEN_A, OPEN_O, STRING, Nodes

VALUE = st.recursive(st.none() | st.booleans() | st.integers(-999, 999) | st.text(max_size=6) | st.sampled_from(['"', "\\", "{", "]", "\\\\\"", "é日"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12)


def rebuilt(tree: Nodes, node: int):
    kids = tree.by_parent[tree.first[node] : tree.first[node + 1]].tolist()
    if tree.kind[node] == OPEN_A:
        return [rebuilt(tree, k) for k in kids]
    if tree.kind[node] == OPEN_O:
        names = {v: k for k, v in tree.names.items()}
        return {names[int(tree.key[k])]: rebuilt(tree, k) for k in kids}
    text = tree._strings(tree.token[[node]]).to_pylist()[0]
    return text if tree.kind[node] == STRING else json.loads(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUE, min_size=1, max_size=5), st.booleans(), st.sampled_from([None, 2]))
def test_round_trip(values, ascii_only, indent):
    tree = Nodes(pa.array([json.dumps(v, ensure_ascii=ascii_only, indent=indent).encode("utf-8", "replace").decode() for v in values]))
    assert tree.valid.all()
    assert [rebuilt(tree, int(r)) for r in tree.root] == [json.loads(json.dumps(v).encode("utf-8", "replace")) if ascii_only else json.loads(json.dumps(v, ensure_ascii=False).encode("utf-8", "replace")) for v in values]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('{}[]:,"\\ 10atruen.-e', max_size=9), min_size=1, max_size=6))
def test_what_is_valid(texts):
    tree = Nodes(pa.array(texts))
    for text, valid, root in zip(texts, tree.valid, tree.root):
        try:
            want = json.loads(text)
        except ValueError:
            assert not valid and root == -1, text
        else:
            assert valid, text
            got = rebuilt(tree, int(root))
            assert got == want or got != got, text


@pytest.mark.parametrize("text", ['{"a":1', '{"a" 1}', '[1,]', '{"a":1,}', '[1 2]', '"a"b"', "{]", "01", "nul", "", " ", '"\\x"', '"\n"', '{"a":1}}', "[1}", '{1:2}', '["a":1]', "1,2", '{,"a":1}', "NaN"])
def test_not_valid(text):
    tree = Nodes(pa.array(['{"k":[1]}', text, '{"k":["' + "x" * 100 + '"]}']))
    assert tree.valid.tolist() == [True, False, True]
    assert tree.strings(tree.by_parent[tree.first[tree.child(tree.root[[2]], "k")[0]]][None]).to_pylist() == ["x" * 100]


def test_last_of_equal_names_counts():
    tree = Nodes(pa.array(['{"a":1,"b":{"a":3},"a":2}']))
    assert tree.strings(tree.child(tree.root, "a")).to_pylist() == ["2"]


def test_slices_and_empty():
    column = pa.array(["[1]", '{"a":"b"}', "[2]"])
    assert Nodes(column.slice(1, 1)).strings(Nodes(column.slice(1, 1)).child(Nodes(column.slice(1, 1)).root, "a")).to_pylist() == ["b"]
    assert len(Nodes(pa.array([], pa.string())).root) == 0
    assert Nodes(pa.array(["", ""])).valid.tolist() == [False, False]
