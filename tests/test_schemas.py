"""Documents checked by the rules that schema files give their classes."""

import json

import pytest

from tessera.operators import schemas, store

SCHEMAS = [
    {"classname": "base", "superclasses": [], "base": [{"name": "id", "type": "did_uid", "parameters": 4}, {"name": "datestamp", "type": "timestamp"}]},
    {
        "classname": "thing", "superclasses": ["base"], "depends_on": [{"name": "a_id", "mustbenotempty": 1}, {"name": "b_id", "mustbenotempty": 0}],
        "thing": [
            {"name": "n", "type": "integer", "parameters": [1, 9, 1]}, {"name": "x", "type": "double", "parameters": [0, 1, 1]}, {"name": "m", "type": "matrix"},
            {"name": "s", "type": "structure"}, {"name": "t", "type": "timestamp"}, {"name": "c", "type": "char", "parameters": 2}, {"name": "u", "type": "cell"}, {"type": "string"},
        ],
    },
    {"classname": "sub", "superclasses": ["thing"], "sub": []},
    {"classname": "loop", "superclasses": ["loop2"], "loop": []}, {"classname": "loop2", "superclasses": ["loop"], "loop2": [{"name": "z", "type": "string"}]},
]
GOOD = {"n": 3.0, "x": 7, "m": [1, [2]], "s": {"k": 1}, "t": "2020-01-02T03:04:05Z", "c": "abc", "u": {}}


@pytest.fixture(scope="module")
def rules(spark):
    texts = [json.dumps(s) for s in SCHEMAS] + ["{}", "not json", '{"classname": null}']
    return schemas.compile_rules(schemas.parse_schemas(spark.createDataFrame([(t,) for t in texts], "value string")))


def check(spark, rules, docs, known=None):
    texts = [json.dumps(d) for d in docs]
    return sorted(map(tuple, schemas.validate_by_class(store.from_json(spark.createDataFrame([(t,) for t in texts], "value string")), rules, known).collect()))


def doc(ident, kind="thing", edges=(("a_id", "x1"),), **sections):
    return {"base": {"id": ident, "datestamp": "2020-01-01T00:00:00"}, "document_class": {"class_name": kind}, "depends_on": [{"name": n, "value": v} for n, v in edges], **sections}


def test_types_ranges_and_missing_parts(spark, rules):
    bad = {"n": 3.5, "x": "1", "m": {"a": 1}, "s": [1], "t": "yesterday", "c": 5, "u": 1}
    empty = dict.fromkeys(GOOD, "") | {"n": None}
    docs = [
        doc("good", thing=GOOD), doc("null", thing=empty), doc("bad1", thing=bad), doc("rang", thing=GOOD | {"n": 10}), doc("bool", thing=GOOD | {"n": True, "x": False}),
        doc("some", thing={"n": 1}), doc("none"), doc("list", thing=[1]), doc("toolong", thing=GOOD), doc("edge", thing=GOOD, edges=[("a_id", ""), ("b_id", "")]),
        doc("deps", thing=GOOD, edges=[]), doc("free", kind="other"), doc("subs", kind="sub", edges=[], thing=GOOD | {"n": 0}), doc("loop", kind="loop", edges=[]),
    ]
    fields = [f"thing.{k}" for k in ("n", "x", "m", "s", "t", "c")]
    want = [("bad1", "this", f, "type") for f in fields] + [("rang", "this", "thing.n", "range")]
    want += [("some", "this", f"thing.{k}", "missing property") for k in "xmstcu"] + [(i, "this", "thing", "missing section") for i in ("none", "list")]
    want += [("toolong", "base", "base.id", "length"), ("edge", "depends_on", "a_id", "empty"), ("deps", "depends_on", "a_id", "missing")]
    want += [("subs", "thing", "thing.n", "range"), ("loop", "loop2", "loop2", "missing section")]
    assert check(spark, rules, docs) == sorted(want)


def test_dependencies_that_name_no_document(spark, rules):
    known = spark.createDataFrame([("x1",), ("x1",)], "id string")
    docs = [doc("good", thing=GOOD), doc("miss", thing=GOOD, edges=[("a_id", "x2"), ("b_id", "x3"), ("b_id", "x1")]), doc("more", thing=GOOD, edges=[("a_id", "x1"), ("other", "x9")])]
    assert check(spark, rules, docs, known) == [("miss", "depends_on", "a_id", "dangling"), ("miss", "depends_on", "b_id", "dangling")]


def test_no_rules_and_no_documents(spark, rules):
    assert check(spark, rules, [doc("free", kind="other")]) == []
    none = schemas.compile_rules(schemas.parse_schemas(spark.createDataFrame([], "value string")))
    assert check(spark, none, [doc("good", thing=GOOD)]) == []
