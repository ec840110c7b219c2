"""Documentation records from catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import variant as V
from logloom.functions.spread import listed, lookup_large, with_ordinal


def format_fields(fields: DataFrame) -> DataFrame:
    """Field rows with defaults filled; ``enum_values`` only on enum fields."""
    have = set(fields.columns)

    def column(name: str, default) -> Column:
        if name not in have:
            return F.lit(default)
        return F.col(name) if default is None else F.coalesce(F.col(name), F.lit(default))

    values = F.coalesce("values", F.expr("cast(array() as array<string>)"))
    return fields.select(
        "class_uid",
        "pos",
        column("name", "").alias("name"),
        column("type", "").alias("type"),
        column("description", "").alias("description"),
        column("required", False).alias("required"),
        column("default", None).cast("string").alias("default"),
        F.when(F.col("type") == "enum", values).alias("enum_values"),
        column("example", None).cast("string").alias("example"),
    )


def _or(path: str, default: str, as_type: str = "string") -> str:
    """SQL text of a value of field ``f``, with a default only if the key is missing."""
    missing = f"{V.sql('f', path, 'variant')} IS NULL"
    return f"CASE WHEN {missing} THEN {default} ELSE {V.sql('f', path, as_type)} END"


def _field_docs(doc: str) -> Column:
    values = f"coalesce({V.sql('f', '$.values', 'array<string>')}, cast(array() AS array<string>))"
    field = ", ".join(
        [
            f"'name', {_or('$.name', repr(''))}",
            f"'type', {_or('$.type', repr(''))}",
            f"'description', {_or('$.description', repr(''))}",
            f"'required', {_or('$.required', 'false', 'boolean')}",
            f"'default', {V.sql('f', '$.default')}",
            f"'enum_values', CASE WHEN {V.sql('f', '$.type')} = 'enum' THEN {values} END",
            f"'example', {V.sql('f', '$.example')}",
        ]
    )
    listed = f"transform({V.sql(doc, '$.fields', 'array<variant>')}, f -> named_struct({field}))"
    return F.expr(f"coalesce({listed}, array())")


def class_docs(classes: DataFrame, uid=None) -> DataFrame:
    """Documentation record per class, or of the one class with ``uid`` (compared as text)."""
    chosen = classes if uid is None else classes.filter(F.col("uid").cast("string") == str(uid))
    return chosen.select(
        V.get_or("doc", "$.caption", "").alias("title"),
        V.get_or("doc", "$.description", "").alias("description"),
        V.get_or("doc", "$.uid", "").alias("uid"),
        V.get_or("doc", "$.version", "").alias("version"),
        _field_docs("doc").alias("fields"),
        F.coalesce(V.get("doc", "$.examples", "array<variant>"), F.expr("array()")).alias("examples"),
        F.struct(
            V.get("doc", "$.extends").alias("extends"),
            F.expr("cast(array() as array<string>)").alias("extended_by"),
            F.expr("cast(array() as array<string>)").alias("referenced_by"),
        ).alias("relationships"),
    )


def category_docs(categories: DataFrame) -> DataFrame:
    return categories.select(
        "pos",
        F.coalesce("caption", F.lit("")).alias("name"),
        "description",
        "uid",
        "type",
        V.get("doc", "$.classes").alias("classes"),
        _field_docs("doc").alias("fields"),
    )


def category_relations(categories: DataFrame) -> DataFrame:
    return categories.filter(F.col("related_to") != "").select(
        F.col("uid").alias("from"), F.col("related_to").alias("to"), F.lit("related").alias("type")
    )


def field_occurrences(fields: DataFrame) -> DataFrame:
    """(name, occurrences, n_types, n_classes) per field name."""
    return fields.groupBy("name").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count_distinct(F.coalesce("type", F.lit("\0"))).alias("n_types"),
        F.count_distinct("class_uid").alias("n_classes"),
    )


def common_fields(fields: DataFrame) -> DataFrame:
    """Field names that occur more than once."""
    return field_occurrences(fields).filter(F.col("occurrences") > 1)


def field_type_sets(fields: DataFrame) -> DataFrame:
    """(name, type) of every type a field name occurs with."""
    return fields.select("name", "type").distinct()


def field_class_lists(fields: DataFrame) -> DataFrame:
    """(name, ordinal, class_uid) of every occurrence of a field name, in order."""
    return listed(fields, ["name"], "pos", "class_uid")


def type_reference(fields: DataFrame) -> DataFrame:
    """Per type with an example: the first one, and the number of field names of that type."""
    example = F.when(F.col("example") != "", F.col("example"))
    return (
        fields.groupBy("type")
        .agg(
            F.min_by(example, F.when(example.isNotNull(), F.col("pos"))).alias("example"),
            F.count_distinct("name").alias("classes_count"),
        )
        .filter(F.col("example").isNotNull())
    )


def usage_patterns(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Field names that occur in exactly the same set of more than one class.

    Returns (pattern, field_count, occurrence_count, rank) and (pattern, name).
    The class set of a name is never gathered: names are compared by the size of
    the set and two independent 64-bit sums over its members, which combine
    before the shuffle. A pattern is called by its first name.
    """
    pairs = fields.select("name", "class_uid").distinct()
    prints = pairs.groupBy("name").agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.sum(F.xxhash64("class_uid").cast("decimal(38,0)")).alias("_a"),
        F.sum(F.xxhash64(F.lit(17), "class_uid").cast("decimal(38,0)")).alias("_b"),
    ).filter(F.col("occurrence_count") > 1)
    same = ["occurrence_count", "_a", "_b"]
    groups = (
        prints.groupBy(*same)
        .agg(F.count(F.lit(1)).alias("field_count"), F.min("name").alias("pattern"))
        .filter(F.col("field_count") > 1)
    )
    members = lookup_large(prints, groups, same, ["name"], how="inner").select("pattern", "name")
    ranked = with_ordinal(
        groups.select("pattern", "field_count", "occurrence_count"),
        [],
        [F.desc("occurrence_count"), F.col("pattern")],
        "rank",
    )
    return ranked, members


def pattern_classes(patterns: DataFrame, fields: DataFrame) -> DataFrame:
    """(pattern, class_uid) of the classes a pattern occurs in."""
    named = fields.select(F.col("name").alias("pattern"), "class_uid").distinct()
    return lookup_large(named, patterns.select("pattern"), ["pattern"], ["class_uid"], how="left_semi")
