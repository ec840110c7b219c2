"""Validation of JSON records against JSON Schema documents, as joins.

A schema document becomes rule rows: the path of the values it speaks of, a
keyword and its argument. ``$ref`` is followed as deep as the records go, so a
schema may refer to itself. A record becomes a row per value: its path with and
without the places in lists, its type and its text. The two are joined by class
and path. Alternatives (``anyOf``, ``oneOf``, ``not``) are scopes: violations in
a branch are counted per value the alternative applies to, the innermost first,
and what the alternative makes of them is a violation in the scope around it.

Keywords: type, enum, const, required, properties, additionalProperties if false,
items, minimum, maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength,
pattern, minItems, maxItems, allOf, anyOf, oneOf, not, $ref within the document;
true and false as schemas. Other keywords say nothing here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.spread import lookup_large
from logloom.session import cut_lineage

# Rules, or classes with a schema, that are broadcast; of more, the hot keys are dealt out
MOST_RULES = 100_000
RULES = "path string, keyword string, texts array<string>, number double, scopes array<struct<id: string, branch: int, depth: int>>"
# Keywords with a number for an argument: what of a value is compared, and which results are violations
BOUNDS = {
    "minimum": ("number", "<"), "maximum": ("number", ">"), "exclusiveMinimum": ("number", "<="), "exclusiveMaximum": ("number", ">="),
    "minLength": ("length", "<"), "maxLength": ("length", ">"), "minItems": ("items", "<"), "maxItems": ("items", ">"),
}


def step(name: str) -> str:
    """A key as a step of a path."""
    return "." + name.replace("~", "~0").replace(".", "~1").replace("[", "~2")


def canonical(value) -> str:
    """A JSON value as text under which equal values are equal: numbers by value, keys in order."""
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return f"#{float(value)!r}"
    if isinstance(value, str):
        return "'" + value
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def rules_of(document: dict | bool, depth: int) -> Iterator[tuple]:
    """Rows of ``RULES`` of one schema document, for values up to ``depth`` steps down."""
    stack: list = [(document, "", 0, (), ())]
    while stack:
        schema, path, down, scopes, seen = stack.pop()
        if schema is False:
            yield path, "never", None, None, scopes
        if not isinstance(schema, dict):
            continue
        if "$ref" in schema:
            pointer = schema["$ref"]
            # a reference that leads to itself without a step down says nothing
            if pointer not in seen:
                stack.append((resolved(document, pointer), path, down, scopes, (*seen, pointer)))
        kinds = schema.get("type")
        if kinds is not None:
            yield path, "type", [kinds] if isinstance(kinds, str) else list(kinds), None, scopes
        if "enum" in schema or "const" in schema:
            yield path, "enum", [canonical(v) for v in schema.get("enum", [schema.get("const")])], None, scopes
        if "pattern" in schema:
            yield path, "pattern", [schema["pattern"]], None, scopes
        for keyword in BOUNDS:
            if keyword in schema:
                yield path, keyword, None, float(schema[keyword]), scopes
        for name in schema.get("required", ()):
            yield path, "required", [name], None, scopes
        known = schema.get("properties", {})
        for part in schema.get("allOf", ()):
            stack.append((part, path, down, scopes, seen))
        for kind in ("anyOf", "oneOf", "not"):
            branches = schema.get(kind)
            if branches is not None:
                branches = [branches] if kind == "not" else branches
                name = md5(f"{path}|{kind}|{json.dumps(schema, sort_keys=True)}|{scopes}".encode()).hexdigest()
                yield path, kind, [name], float(len(branches)), scopes
                for n, branch in enumerate(branches):
                    stack.append((branch, path, down, (*scopes, (name, n, down)), seen))
        if down < depth:
            for name, part in known.items():
                stack.append((part, path + step(name), down + 1, scopes, ()))
            if "items" in schema:
                stack.append((schema["items"], path + "[]", down + 1, scopes, ()))
        if schema.get("additionalProperties") is False:
            yield path, "closed", sorted(known), None, scopes


def resolved(document, pointer: str):
    at = document
    for part in pointer.removeprefix("#").split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        at = at[int(part)] if isinstance(at, list) else at.get(part, True) if isinstance(at, dict) else True
    return at


def compiled(schemas: DataFrame, depth: int) -> DataFrame:
    """(class_uid, rule) rows of ``schemas`` (class_uid, schema as JSON text), each document compiled in a task."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "keyword", "texts", "number", "scopes"]
        for batch in batches:
            for uid, text in zip(batch["class_uid"], batch["schema"]):
                rows = pd.DataFrame(list(rules_of(json.loads(text), depth)), columns=names, dtype=object)
                rows["scopes"] = [[{"id": i, "branch": b, "depth": d} for i, b, d in s] for s in rows["scopes"]]
                rows.insert(0, "class_uid", uid)
                if len(rows):
                    yield rows

    kind = schemas.schema["class_uid"].dataType.simpleString()
    rows = schemas.select("class_uid", "schema").filter("class_uid is not null and schema is not null")
    return rows.mapInPandas(of, f"class_uid {kind}, {RULES}")


def values(records: DataFrame) -> DataFrame:
    """A row per value of ``records`` (record_id, class_uid, doc as VARIANT), a round per level of nesting.

    (record_id, class_uid, at, path, v): ``at`` are the steps to the value with its
    places in lists, ``path`` the same without.
    """
    level = cut_lineage(
        records.filter("doc is not null").select(
            "record_id", "class_uid", F.array().cast("array<string>").alias("at"), F.lit("").alias("path"), F.col("doc").alias("v")
        )
    )
    found = level
    while True:
        # objects give a row per key, lists one per place
        level = level.sparkSession.sql(
            "SELECT record_id, class_uid, at, path, e.pos, e.key, e.value AS v FROM {level}, LATERAL variant_explode(v) AS e", level=level
        )
        key = F.concat(F.lit("."), _escaped("key"))
        level = cut_lineage(
            level.select(
                "record_id",
                "class_uid",
                F.array_append("at", F.coalesce(key, F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))).alias("at"),
                F.concat("path", F.coalesce(key, F.lit("[]"))).alias("path"),
                "v",
            )
        )
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def _escaped(key: str) -> Column:
    out = F.col(key)
    for mark, code in (("~", "~0"), (".", "~1"), ("[", "~2")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def _described(rows: DataFrame) -> DataFrame:
    """What rules ask of a value, beside it: kind, number, text, items, keys and its canonical text."""
    code = F.schema_of_variant("v")
    of = lambda kind: F.try_variant_get("v", "$", kind)
    kind = (
        F.when(code.startswith("OBJECT"), "object").when(code.startswith("ARRAY"), "array").when(code == "STRING", "string")
        .when(code == "BOOLEAN", "boolean").when(code == "VOID", "null").otherwise("number")
    )
    rows = rows.withColumn("kind", kind)
    is_ = lambda name, value: F.when(F.col("kind") == name, value)
    return rows.select(
        "*",
        is_("number", of("double")).alias("as_number"),
        is_("string", of("string")).alias("as_text"),
        is_("array", F.size(of("array<variant>"))).alias("n_items"),
        is_("object", F.map_keys(of("map<string, variant>"))).alias("keys"),
        F.when(F.col("kind") == "string", F.concat(F.lit("'"), of("string"))).otherwise(F.to_json("v")).alias("canonical"),
    )


def _violation(where: Column) -> Column:
    """The text of the violation that a rule finds in the value beside it; null if none."""
    keyword, texts, number, kind = F.col("keyword"), F.col("texts"), F.col("number"), F.col("kind")
    whole = F.col("as_number") == F.floor("as_number")
    fits = F.array_contains(texts, kind) | ((kind == "number") & whole & F.array_contains(texts, "integer"))
    equal = F.when(
        kind == "number",
        F.exists(texts, lambda t: t.startswith("#") & (F.substring(t, 2, 400).try_cast("double") == F.col("as_number"))),
    ).otherwise(F.array_contains(texts, F.col("canonical")))
    said = lambda *parts: F.concat(where, F.lit(": "), *parts)
    named = F.element_at(texts, 1)
    unknown = F.array_sort(F.array_except("keys", texts))
    out = (
        F.when((keyword == "type") & ~F.coalesce(fits, F.lit(False)), said(F.lit("not of type "), F.array_join(texts, ", ")))
        .when((keyword == "enum") & ~F.coalesce(equal, F.lit(False)), said(F.lit("value not allowed")))
        .when((keyword == "pattern") & (kind == "string") & ~F.expr("as_text RLIKE element_at(texts, 1)"), said(F.lit("does not match "), named))
        .when((keyword == "required") & (kind == "object") & ~F.array_contains("keys", named), said(named, F.lit(" required")))
        .when((keyword == "closed") & (kind == "object") & (F.size(unknown) > 0), said(F.lit("unknown "), F.array_join(unknown, ", ")))
        .when(keyword == "never", said(F.lit("not allowed")))
    )
    sizes = {"number": F.col("as_number"), "length": F.char_length("as_text").cast("double"), "items": F.col("n_items").cast("double")}
    for name, (of, sign) in BOUNDS.items():
        value = sizes[of]
        wrong = {"<": value < number, ">": value > number, "<=": value <= number, ">=": value >= number}[sign]
        out = out.when((keyword == name) & F.coalesce(wrong, F.lit(False)), said(F.lit(name + " "), number.cast("string")))
    return out


# What makes an alternative a violation, of its branches and the failing ones, and how that is said
ALTERNATIVES = {
    "anyOf": ("failed = branches", "matches none of the alternatives"),
    "oneOf": ("branches - failed <> 1", "does not match one of the alternatives"),
    "not": ("failed = 0", "matches what it must not"),
}


def _beside(rows: DataFrame, per_class: DataFrame, n: int, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` of records joined to ``n`` rows that classes have; a class may hold most of the records."""
    if n <= MOST_RULES:
        return rows.join(F.broadcast(per_class), on, how)
    return lookup_large(rows, per_class, on, ["record_id"], how)


def violations(records: DataFrame, schemas: DataFrame) -> DataFrame:
    """(record_id, violation): what ``schemas`` (class_uid, schema) find wrong in ``records`` (record_id, class_uid, doc)."""
    found = values(_beside(records, schemas.select("class_uid").distinct(), schemas.count(), ["class_uid"], "left_semi"))
    depth = found.agg(F.coalesce(F.max(F.size("at")), F.lit(0))).first()[0]
    rules = cut_lineage(compiled(schemas, depth))
    n_rules = rules.count()
    kinds = list(ALTERNATIVES)
    nesting = rules.agg(F.coalesce(F.max(F.size("scopes") + F.col("keyword").isin(*kinds).cast("int")), F.lit(0))).first()[0]
    where = F.concat(F.lit("$"), F.array_join("at", ""))
    plain = rules.filter(~F.col("keyword").isin(*kinds))
    # values of which no rule speaks need no description
    named = _described(_beside(found, plain.select("class_uid", "path").distinct(), n_rules, ["class_uid", "path"], "left_semi"))
    errors = _beside(named, plain, n_rules, ["class_uid", "path"]).select("record_id", "at", "scopes", _violation(where).alias("violation"))
    errors = errors.filter("violation is not null")
    if not nesting:
        return errors.select("record_id", "violation")
    errors = cut_lineage(errors)
    choices = rules.filter(F.col("keyword").isin(*kinds)).select(
        "class_uid", "path", "keyword", F.element_at("texts", 1).alias("id"), F.col("number").cast("int").alias("branches"), "scopes"
    )
    choices = cut_lineage(_beside(found.select("record_id", "class_uid", "path", "at"), choices.distinct(), n_rules, ["class_uid", "path"]))
    for level in range(nesting, 0, -1):
        scope = F.element_at("scopes", level)
        inner = errors.filter(F.size("scopes") == level).select(
            "record_id", scope["id"].alias("id"), scope["branch"].alias("branch"), F.slice("at", F.lit(1), scope["depth"]).alias("at")
        )
        failed = inner.groupBy("record_id", "id", "at").agg(F.count_distinct("branch").alias("failed"))
        judged = choices.filter(F.size("scopes") == level - 1).join(failed, ["record_id", "id", "at"], "left")
        judged = judged.withColumn("failed", F.coalesce("failed", F.lit(0)))
        text = F.lit(None).cast("string")
        for kind, (wrong, said) in ALTERNATIVES.items():
            text = F.when((F.col("keyword") == kind) & F.expr(wrong), F.concat(where, F.lit(": " + said))).otherwise(text)
        more = judged.select("record_id", "at", "scopes", text.alias("violation")).filter("violation is not null")
        errors = cut_lineage(errors.unionByName(more))
    return errors.filter("size(scopes) = 0").select("record_id", "violation")


def check_records(records: DataFrame, schemas: DataFrame) -> DataFrame:
    """``records`` (record_id, class_uid, doc as VARIANT) with ``valid`` and ``violations``; no record is dropped.

    ``schemas`` are (class_uid, schema), a JSON Schema document each as text; what
    several documents of a class find counts together. A record without a schema is
    not valid, nor is one without a document.
    """
    known = schemas.select("class_uid").distinct().withColumn("_known", F.lit(True))
    found = violations(records, schemas).groupBy("record_id").agg(F.array_sort(F.collect_set("violation")).alias("violations"))
    # the document itself need not be sorted for the join where nobody asks for it afterwards
    rows = _beside(records, known, schemas.count(), ["class_uid"], "left").withColumn("_none", F.col("doc").isNull())
    rows = rows.join(found, "record_id", "left")
    none = F.array(F.concat(F.lit("no schema for class "), F.coalesce(F.col("class_uid").cast("string"), F.lit("None"))))
    listed = (
        F.when(F.col("_known").isNull(), none)
        .when(F.col("_none"), F.array(F.lit("no document")))
        .otherwise(F.coalesce("violations", F.array().cast("array<string>")))
    )
    return rows.withColumn("violations", listed).withColumn("valid", F.size("violations") == 0).drop("_known", "_none")
