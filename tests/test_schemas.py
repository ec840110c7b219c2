"""JSON Schema documents as joins, against a plain recursive validator."""

import json
import random
import re

from pyspark.sql import functions as F

from logloom.operators import schemas as s


def kinds_of(v):
    if isinstance(v, bool):
        return {"boolean"}
    if v is None:
        return {"null"}
    if isinstance(v, (int, float)):
        return {"number", "integer"} if float(v).is_integer() else {"number"}
    return {{str: "string", list: "array", dict: "object"}[type(v)]}


def plain(doc, schema, v):
    """Whether a value meets a schema."""
    if isinstance(schema, bool):
        return schema
    if "$ref" in schema:
        at = doc
        for part in schema["$ref"].removeprefix("#").split("/")[1:]:
            at = at[part]
        if not plain(doc, at, v):
            return False
    kinds = kinds_of(v)
    ok = True
    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        ok &= bool(kinds & set(wanted))
    for key in ("enum", "const"):
        if key in schema:
            ok &= any(kinds_of(e) & kinds and e == v for e in (schema[key] if key == "enum" else [schema[key]]))
    if "number" in kinds:
        ok &= v >= schema.get("minimum", v) and v <= schema.get("maximum", v)
        ok &= "exclusiveMinimum" not in schema or v > schema["exclusiveMinimum"]
        ok &= "exclusiveMaximum" not in schema or v < schema["exclusiveMaximum"]
    if isinstance(v, str):
        ok &= schema.get("minLength", 0) <= len(v) <= schema.get("maxLength", len(v))
        ok &= "pattern" not in schema or re.search(schema["pattern"], v) is not None
    if isinstance(v, list):
        ok &= schema.get("minItems", 0) <= len(v) <= schema.get("maxItems", len(v))
        ok &= all(plain(doc, schema.get("items", True), x) for x in v)
    if isinstance(v, dict):
        ok &= all(k in v for k in schema.get("required", ()))
        known = schema.get("properties", {})
        ok &= all(plain(doc, known[k], x) for k, x in v.items() if k in known)
        ok &= schema.get("additionalProperties", True) is not False or set(v) <= set(known)
    ok &= all(plain(doc, p, v) for p in schema.get("allOf", ()))
    ok &= "anyOf" not in schema or any(plain(doc, p, v) for p in schema["anyOf"])
    ok &= "oneOf" not in schema or sum(plain(doc, p, v) for p in schema["oneOf"]) == 1
    ok &= "not" not in schema or not plain(doc, schema["not"], v)
    return ok


def random_schema(rng, depth, below=False, refs=True):
    """``below``: a reference to the whole document leads a step down, so it ends."""
    out = {}
    if rng.random() < 0.6:
        out["type"] = rng.choice(["object", "array", "string", "integer", "number", ["object", "array"], ["string", "null"], "boolean"])
    if rng.random() < 0.2:
        out["enum"] = rng.choice([["a", 1, None], [True, 2.5], ["b", "c", 3]])
    if rng.random() < 0.2:
        out["pattern"] = rng.choice(["^a", "b$", "[0-9]"])
    for key, top in (("minimum", 4), ("exclusiveMaximum", 6), ("minLength", 3), ("maxItems", 3), ("minItems", 2)):
        if rng.random() < 0.1:
            out[key] = rng.randrange(top)
    if rng.random() < 0.25:
        out["required"] = rng.sample(["a", "b.c", "d["], rng.randrange(1, 3))
    if depth:
        if rng.random() < 0.7:
            out["properties"] = {k: random_schema(rng, depth - 1, True, refs) for k in rng.sample(["a", "b.c", "d[", "~e"], rng.randrange(1, 4))}
        if rng.random() < 0.4:
            out["items"] = random_schema(rng, depth - 1, True, refs)
        if rng.random() < 0.15:
            out["additionalProperties"] = False
        for key in ("anyOf", "oneOf", "allOf"):
            if rng.random() < 0.15:
                out[key] = [random_schema(rng, depth - 1, False, refs) for _ in range(rng.randrange(1, 4))]
        if rng.random() < 0.1:
            out["not"] = random_schema(rng, depth - 1, False, refs)
        if refs and rng.random() < 0.15:
            out["$ref"] = "#" if below and rng.random() < 0.2 else "#/$defs/x"
    return out


def random_value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.45:
        return {k: random_value(rng, depth - 1) for k in rng.sample(["a", "b.c", "d[", "~e", "f"], rng.randrange(4))}
    if depth and kind < 0.65:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(5))]
    return rng.choice(["a", "b", "abc9", "", 1, 2, 2.5, 7, 3.0, True, False, None])


def test_equals_a_plain_validator(spark):
    rng = random.Random(11)
    schemas = []
    for uid in range(30):
        doc = random_schema(rng, 3)
        doc["$defs"] = {"x": random_schema(rng, 1, refs=False)}
        schemas.append((uid, doc))
    records = [(n, n % 31, random_value(rng, 3)) for n in range(900)]
    frame = spark.createDataFrame([(n, c, json.dumps(v)) for n, c, v in records], "record_id long, class_uid long, t string")
    frame = frame.select("record_id", "class_uid", F.parse_json("t").alias("doc"))
    given = spark.createDataFrame([(u, json.dumps(d)) for u, d in schemas], "class_uid long, schema string")
    got = {r.record_id: r for r in s.check_records(frame, given).select("record_id", "valid", "violations").collect()}
    known = dict(schemas)
    assert len(got) == len(records)
    for n, c, v in records:
        want = c in known and plain(known[c], known[c], v)
        assert got[n].valid == want, (known.get(c), v, got[n].violations)
        assert got[n].valid == (not got[n].violations)
    assert 50 < sum(r.valid for r in got.values()) < 850


def checked(spark, schema, docs):
    frame = spark.createDataFrame([(i, 1, json.dumps(d) if d is not ... else None) for i, d in enumerate(docs)], "record_id long, class_uid long, t string")
    given = spark.createDataFrame([(1, json.dumps(schema)), (None, "{}"), (2, None)], "class_uid long, schema string")
    rows = s.check_records(frame.select("record_id", "class_uid", F.try_parse_json("t").alias("doc")), given).orderBy("record_id").collect()
    return [list(r.violations) for r in rows]


def test_references_that_refer_to_themselves(spark):
    tree = {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "required": ["n"], "properties": {"kids": {"items": {"$ref": "#/$defs/node"}}}}}}
    good = {"n": 1, "kids": [{"n": 2, "kids": [{"n": 3, "kids": []}]}]}
    bad = {"n": 1, "kids": [{"n": 2}, {"kids": [{"n": 1}, 5, {"kids": [{}]}]}]}
    assert checked(spark, tree, [good, bad, ...]) == [
        [], ["$.kids[1].kids[1]: not of type object", "$.kids[1].kids[2].kids[0]: n required", "$.kids[1].kids[2]: n required", "$.kids[1]: n required"], ["no document"]
    ]
    assert checked(spark, {"$ref": "#"}, [1, {}]) == [[], []]


def test_texts_of_violations(spark):
    schema = {
        "properties": {
            "a": {"enum": ["x", 1]}, "b": {"type": ["string", "null"], "pattern": "^q"}, "c": {"minimum": 2, "exclusiveMaximum": 5},
            "d": {"oneOf": [{"type": "number"}, {"type": "integer"}]}, "e": False, "f": {"items": {"anyOf": [{"const": 1}, {"not": {"type": "number"}}]}},
        },
        "additionalProperties": False,
    }
    docs = [
        {"a": 1.0, "b": None, "c": 2, "d": 2.5, "f": [1, "x"]},
        {"a": "1", "b": "x", "c": 5, "d": 2, "e": 0, "f": [1, 2], "g": 0, "h": 0},
        {"a": 2, "b": 3},
    ]
    assert checked(spark, schema, docs) == [
        [],
        ["$.a: value not allowed", "$.b: does not match ^q", "$.c: exclusiveMaximum 5.0", "$.d: does not match one of the alternatives",
         "$.e: not allowed", "$.f[1]: matches none of the alternatives", "$: unknown g, h"],
        ["$.a: value not allowed", "$.b: not of type string, null"],
    ]


def test_more_rules_than_a_driver_would_hold(spark):
    schema = {"properties": {f"p{i}": {"type": "integer", "minimum": i} for i in range(12_000)}}
    found = checked(spark, schema, [{"p11999": 11_998, "p0": 0, "p5": "x"}, {}])
    assert found == [["$.p11999: minimum 11999.0", "$.p5: not of type integer"], []]


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, 1, "{}")], "record_id long, class_uid long, t string").select("record_id", "class_uid", F.parse_json("t").alias("doc"))
    none = spark.createDataFrame([], "class_uid long, schema string")
    row = s.check_records(frame, none).first()
    assert not row.valid and row.violations == ["no schema for class 1"]
    assert s.check_records(frame.limit(0), spark.createDataFrame([(1, "{}")], "class_uid long, schema string")).count() == 0
