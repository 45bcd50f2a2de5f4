"""Elements of documents and the rules of the standards on planted violations."""

import json

from segforge.operators import elements as E


def doc(version, **file):
    return json.dumps({"xliff": {"version": version, "srcLang": "en", "trgLang": "de", "file": [{"id": "f", "original": "a", **file}]}})


def found(spark, *payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "rec_id bigint, payload string")
    return sorted((r["rule_id"], r["rec_id"], r["detail"]) for r in E.violations(E.elements(df)).collect())


def test_planted_violations(spark):
    one = doc("1.2", **{"source-language": "en", "datatype": "x", "target-language": "?!", "body": {"trans-unit": [{"id": 1, "source": "a", "approved": "maybe"}, {"id": 1, "source": "b"}, {"source": "c", "alt-trans": {"match-quality": 101, "target": "t"}, "target": {"state": "done"}}]}})
    got = {(rule, detail) for rule, _, detail in found(spark, one)}
    assert got == {("v1-file-target-language-pattern", "?!"), ("v1-trans-unit-approved-pattern", "maybe"), ("v1-trans-unit-id-unique", "1"), ("v1-trans-unit-id-required", "id"), ("v1-alt-trans-match-quality-pattern", "101"), ("v1-target-state-pattern", "done")}


def test_uniqueness_is_by_file_and_references_resolve(spark):
    unit = {"id": "u", "name": "n", "segment": {"id": "s", "state": "final", "source": "a"}, "matches": {"ref": "#s", "source": "a", "target": "b"}}
    two = json.dumps({"xliff": {"version": "2.0", "srcLang": "en", "trgLang": "de", "file": [{"id": "f", "original": "a", "unit": unit}, {"id": "g", "original": "b", "unit": unit}]}})
    assert found(spark, two) == []
    bad = json.loads(two)
    bad["xliff"]["file"][0]["unit"]["matches"]["ref"] = "#nowhere"
    assert [r[0] for r in found(spark, json.dumps(bad))] == ["v2-matches-ref-reference"]


def test_edges(spark):
    assert found(spark, None, "", "{", "[]", "1", '{"xliff": {"version": "9"}}') == []
    df = spark.createDataFrame([(1, doc("2.1"), "x")], "rec_id bigint, payload string, value string")
    assert E.xliff_languages(E.elements(df)).collect()[0].asDict() == {"rec_id": 1, "source": "en", "target": "de"}
    assert E.elements(df.limit(0)).count() == 0
