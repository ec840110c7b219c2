"""Validation of mapped records against rules."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import variant as V

# A rule table is configuration, not data; more rules than this is a mistake.
MAX_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """One constraint: ``path`` below the record, whether required, its JSON type, its values."""

    class_uid: int
    path: str
    required: bool = False
    type: str | None = None
    allowed: tuple[str, ...] | None = None


def load_rules(table: DataFrame) -> list[Rule]:
    """Rules from a table (class_uid, path, required, type[, allowed])."""
    rows = table.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [
        Rule(
            r["class_uid"], r["path"], bool(r["required"]), r["type"],
            tuple(r["allowed"]) if "allowed" in table.columns and r["allowed"] else None,
        )
        for r in rows
    ]


def _leaf(schema: T.StructType, root: str, path: str) -> tuple[Column, T.DataType | None, Column]:
    """Column at ``path``, its type (none below a VARIANT, or if there is no such path), and
    whether the key is there."""
    first, *parts = path.split(".")
    if f"{root}{first}" not in schema.names:
        return F.lit(None), None, F.lit(False)
    column, kind, there = F.col(f"{root}{first}"), schema[f"{root}{first}"].dataType, F.lit(True)
    for i, part in enumerate(parts):
        if isinstance(kind, T.VariantType):
            rest = "$." + ".".join(parts[i:])
            value = V.field(".".join([f"{root}{first}", *parts[:i]]), rest)
            return value, None, there & value.isNotNull()
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return F.lit(None), None, F.lit(False)
        there = there & column.isNotNull()
        column, kind = column[part], kind[part].dataType
    return column, kind, there


# JSON types a column type satisfies
_JSON_TYPES = {
    T.StringType: ("string",),
    T.BooleanType: ("boolean",),
    T.IntegerType: ("integer", "number"),
    T.LongType: ("integer", "number"),
    T.DoubleType: ("number",),
    T.StructType: ("object",),
    T.ArrayType: ("array",),
}


def _violation(schema: T.StructType, root: str, rule: Rule) -> Column:
    value, kind, there = _leaf(schema, root, rule.path)
    if kind is None:
        found_value = value.cast("variant")
        text, code = F.try_variant_get(found_value, "$", "string"), F.schema_of_variant(found_value)
        prefixes = {
            "string": ("STRING",), "boolean": ("BOOLEAN",), "integer": ("BIGINT",), "null": ("VOID",),
            "number": ("BIGINT", "DECIMAL", "DOUBLE"), "object": ("OBJECT",), "array": ("ARRAY",),
        }
        fits = F.lit(False)
        for prefix in prefixes.get(rule.type, ()):
            fits = fits | code.startswith(prefix)
    else:
        text = value.cast("string") if not isinstance(kind, (T.StructType, T.ArrayType)) else F.lit(None)
        named = rule.type in _JSON_TYPES.get(type(kind), ())
        fits = value.isNotNull() if named else value.isNull() & F.lit(rule.type == "null")
    found = F.lit(None).cast("string")
    if rule.allowed:
        allowed = F.coalesce(text.isin(*rule.allowed), F.lit(False))
        found = F.when(there & ~allowed, f"{rule.path}: value not allowed").otherwise(found)
    if rule.type:
        found = F.when(there & ~fits, f"{rule.path}: not of type {rule.type}").otherwise(found)
    if rule.required:
        found = F.when(~there, f"{rule.path}: required").otherwise(found)
    return found


def validate(events: DataFrame, rules: Iterable[Rule], prefix: str = "mapped_") -> DataFrame:
    """Add ``valid`` and ``violations``; never drops a row.

    The rules of a class become one array expression over the typed record, so
    validation is part of the projection that maps it. A class without rules is
    not valid.
    """
    by_class: dict[int, list[Rule]] = {}
    for rule in rules:
        by_class.setdefault(rule.class_uid, []).append(rule)
    uid = F.col(f"{prefix}class_uid")
    checks = F.when(F.lit(False), F.expr("array('')"))
    for class_uid in sorted(by_class):
        found = F.array(*[_violation(events.schema, prefix, r) for r in by_class[class_uid]])
        checks = checks.when(uid == class_uid, F.filter(found, lambda v: v.isNotNull()))
    checks = checks.otherwise(
        F.array(F.concat(F.lit("no schema for class "), F.coalesce(uid.cast("string"), F.lit("None"))))
    )
    return events.withColumn("violations", checks).withColumn("valid", F.size("violations") == 0)
