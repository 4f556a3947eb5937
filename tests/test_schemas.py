import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import schemas

SCHEMA = {
    "$schema": "x", "title": "Case", "type": "object", "required": ["id", "kind", "steps"], "additionalProperties": False,
    "properties": {
        "id": {"$ref": "#/$defs/name"}, "kind": {"enum": ["a", "b", 3, None, {"x": [1]}]}, "at": {"type": "string", "format": "date-time"}, "n": {"type": "integer", "minimum": 1, "maximum": 9},
        "ratio": {"type": ["number", "null"]}, "tags": {"type": "array", "items": {"type": "string", "pattern": "^[a-z]+$"}, "minItems": 1, "maxItems": 3, "uniqueItems": True},
        "steps": {"type": "array", "items": {"type": "object", "required": ["op"], "properties": {"op": {"const": "go"}, "who": {"$ref": "#/$defs/name"}}}},
        "pair": {"prefixItems": [{"type": "string"}, {"type": "integer"}], "items": {"type": "boolean"}}, "either": {"oneOf": [{"type": "integer"}, {"minimum": 5}]}, "any": {"anyOf": [{"type": "string"}, {"type": "null"}]},
        "more": {"type": "object", "minProperties": 1, "propertyNames": {"maxLength": 3}, "additionalProperties": {"type": "boolean"}}, "a.b": {"not": {"const": 1}},
    },
    "allOf": [{"if": {"properties": {"kind": {"const": "a"}}}, "then": {"required": ["n"]}, "else": {"properties": {"n": False}}}],
    "$defs": {"name": {"type": "string", "minLength": 2, "maxLength": 5}},
}
GOOD = {"id": "ab", "kind": "a", "n": 2.0, "steps": [{"op": "go", "who": "éé"}], "tags": ["x", "y"], "at": "2025-01-31T10:00:00.5+02:00", "ratio": None, "pair": ["x", 1, True], "either": 2, "any": None, "more": {"abc": True}, "a.b": 2}
#: Changes, and what they break.
CASES = [
    ({}, []), ({"id": "a"}, [("$.id", "minLength")]), ({"id": 5}, [("$.id", "type")]), ({"id": "éééééé"}, [("$.id", "maxLength")]), ({"kind": "c"}, [("$.kind", "enum"), ("$.n", "false")]),
    ({"kind": {"x": [1]}, "n": ...}, []), ({"kind": None, "n": ...}, []), ({"kind": True}, [("$.kind", "enum"), ("$.n", "false")]), ({"n": ...}, [("$.n", "required")]), ({"n": 10}, [("$.n", "maximum")]), ({"n": 1.5}, [("$.n", "type")]),
    ({"at": "2025-13-01T00:00:00Z"}, [("$.at", "format")]), ({"ratio": "x"}, [("$.ratio", "type")]), ({"tags": []}, [("$.tags", "minItems")]), ({"tags": ["a", "a", "B", 4]}, [("$.tags", "maxItems"), ("$.tags", "uniqueItems"), ("$.tags[2]", "pattern"), ("$.tags[3]", "type")]),
    ({"steps": [{}, {"op": "stop"}, 7, {"op": "go", "who": "x"}]}, [("$.steps[0].op", "required"), ("$.steps[1].op", "const"), ("$.steps[2]", "type"), ("$.steps[3].who", "minLength")]), ({"steps": ...}, [("$.steps", "required")]),
    ({"pair": [1, "x", 3]}, [("$.pair[0]", "type"), ("$.pair[1]", "type"), ("$.pair[2]", "type")]), ({"pair": []}, []), ({"either": 6}, [("$.either", "oneOf")]), ({"either": 5.5}, []), ({"either": 4.5}, [("$.either", "oneOf")]), ({"any": 1}, [("$.any", "anyOf")]),
    ({"more": {}}, [("$.more", "minProperties")]), ({"more": {"long": True, "b": 1}}, [("$.more.b", "type"), ("$.more.long", "propertyNames")]), ({"a.b": 1}, [("$.a.b", "not")]), ({"zz": 1, "yy": 2}, [("$.yy", "additionalProperties"), ("$.zz", "additionalProperties")]),
]


def test_each_keyword_is_found_at_its_path(spark):
    docs = []
    for change, _ in CASES:
        doc = {**GOOD, **change}
        docs.append(json.dumps({k: v for k, v in doc.items() if v is not ...}))
    rows = [(i, d, "x") for i, d in enumerate(docs)] + [(900, None, "x"), (901, "{", "x"), (902, "[]", "x"), (903, "null", "x"), (904, "", "x")]
    frame = spark.createDataFrame(rows, "i int, doc string, path string")
    out = schemas.validated(frame, "doc", SCHEMA)
    assert out.columns == ["i", "doc", "path", "violations"]
    got = {r["i"]: [tuple(x) for x in r["violations"]] for r in out.collect()}
    for i, (change, broken) in enumerate(CASES):
        assert got[i] == sorted(broken), change
    assert got[900] == got[901] == got[904] == [("$", "json")]
    assert ("$", "type") in got[902] and ("$", "type") in got[903]


def test_what_cannot_be_compiled_is_an_error():
    for schema in ({"unknown": 1}, {"format": "email"}, {"$ref": "other.json"}, {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}):
        with pytest.raises(ValueError):
            schemas.violations(F.lit("1"), schema)


def test_plain_schemas(spark):
    one = spark.createDataFrame([("1",)], "t string")
    assert one.select(schemas.violations(F.col("t"), True).alias("v"), schemas.violations(F.col("t"), False).alias("w"), schemas.violations(F.col("t"), {}).alias("e")).first() == ([], [("$", "false")], [])
