"""Reading JSON records where a missing key and an explicit null differ.

A lookup with a default falls back only when the key is missing; an explicit
null stays null. ``variant_get`` alone cannot tell the two apart, hence these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql(doc: str, path: str, as_type: str = "string") -> str:
    """SQL text of the value at ``path``, null if missing or of another kind."""
    quoted = path.replace("\\", "\\\\").replace("'", "\\'")
    return f"try_variant_get({doc}, '{quoted}', '{as_type}')"


def field(doc: str, path: str) -> Column:
    return F.expr(sql(doc, path, "variant"))


def is_null(doc: str, path: str) -> Column:
    """The key is there and holds null."""
    return F.expr(f"is_variant_null({sql(doc, path, 'variant')})")


def is_missing(doc: str, path: str) -> Column:
    return F.expr(f"{sql(doc, path, 'variant')} IS NULL")


def get(doc: str, path: str, as_type: str = "string") -> Column:
    return F.expr(sql(doc, path, as_type))


def get_or(doc: str, path: str, default, as_type: str = "string") -> Column:
    """Value at ``path``; ``default`` only if the key is missing."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(is_missing(doc, path), fallback.cast(as_type)).otherwise(get(doc, path, as_type))


def is_object(doc: str, path: str) -> Column:
    return F.expr(f"{sql(doc, path, 'struct<>')} IS NOT NULL")


def is_list(doc: str, path: str) -> Column:
    return F.expr(f"{sql(doc, path, 'array<variant>')} IS NOT NULL")


def code_sql(doc: str, path: str) -> str:
    """SQL text of the first letters of the variant's type name; null if the key is missing."""
    return f"left(schema_of_variant({sql(doc, path, 'variant')}), 2)"


def number_sql(doc: str, path: str) -> str:
    return f"{code_sql(doc, path)} IN ('BI', 'DE', 'DO', 'FL', 'BO')"


def is_number(doc: str, path: str) -> Column:
    """A JSON number, or a boolean, which compares like one."""
    return F.expr(number_sql(doc, path))


def type_name(doc: str, path: str) -> Column:
    """Name of the JSON kind as error texts give it."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in _TYPE_NAMES.items())
    return F.expr(f"try_element_at(map({pairs}), {code_sql(doc, path)})")


# How error texts name the JSON kinds
_TYPE_NAMES = {
    "OB": "dict", "AR": "list", "ST": "str", "BO": "bool", "VO": "NoneType",
    "BI": "int", "DE": "float", "DO": "float", "FL": "float",
}


def parse(raw) -> Column:
    """Parse JSON text; text that encodes a JSON string is decoded once more."""
    return F.try_parse_json(unwrap(raw))


def starts(column, mark: str) -> Column:
    """The first character that is not JSON white space is ``mark``."""
    return F.ltrim(column, F.lit(" \t\r\n")).startswith(mark)


def unwrap(raw) -> Column:
    """JSON text with one layer of string encoding removed where there is one."""
    column = raw if isinstance(raw, Column) else F.col(raw)
    return F.when(
        starts(column, '"'),
        F.try_variant_get(F.try_parse_json(column), "$", "string"),
    ).otherwise(column)
