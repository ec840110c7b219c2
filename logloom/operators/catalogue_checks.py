"""Consistency checks over catalogue tables: references, overrides, enums, cycles.

Every check returns issue rows. A null ``extends`` or ``ref`` counts as absent;
with ``strict`` one that is present and null is an issue, given the tables say
which keys were present (``extends_present``, ``ref_present``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.spread import lookup_large
from logloom.operators.catalogue_stats import class_links
from logloom.operators.graph import ancestor_chains, cycle_members
from logloom.session import cut_lineage


def _text(column, otherwise: str = "None") -> Column:
    c = column if isinstance(column, Column) else F.col(column)
    return F.coalesce(c.cast("string"), F.lit(otherwise))


def _present(frame: DataFrame, name: str, strict: bool) -> Column:
    flag = f"{name}_present"
    given = F.col(name).isNotNull()
    return F.col(flag) | given if strict and flag in frame.columns else given


def _uids(classes: DataFrame, name: str) -> DataFrame:
    return classes.filter(F.col("uid").isNotNull()).select(F.col("uid").alias(name)).distinct()


def broken_parents(classes: DataFrame, strict: bool = False) -> DataFrame:
    """Classes whose ``extends`` names no class."""
    rows = classes.filter(_present(classes, "extends", strict))
    return lookup_large(rows, _uids(classes, "extends"), ["extends"], ["pos"], how="left_anti")


def broken_refs(classes: DataFrame, fields: DataFrame, strict: bool = False) -> DataFrame:
    """Fields whose ``ref`` names no class."""
    rows = fields.filter(_present(fields, "ref", strict))
    return lookup_large(rows, _uids(classes, "ref"), ["ref"], ["pos"], how="left_anti")


def reference_issues(classes: DataFrame, fields: DataFrame, strict: bool = False) -> DataFrame:
    """(type, severity, message) of broken parents and references."""
    parents = broken_parents(classes, strict).select(
        F.concat(
            F.lit("Class "), _text("uid", "Unknown"), F.lit(" extends non-existent class "), _text("extends")
        ).alias("message")
    )
    refs = broken_refs(classes, fields, strict).select(
        F.concat(
            F.lit("Field "), _text("name", "Unknown"), F.lit(" references non-existent class "), _text("ref")
        ).alias("message")
    )
    return parents.unionByName(refs).select(
        F.lit("invalid_reference").alias("type"), F.lit("error").alias("severity"), "message"
    )


def parents_of(classes: DataFrame) -> DataFrame:
    """Classes with ``parent_pos``, the place of the first class that has the uid they extend."""
    first = (
        classes.filter(F.col("uid").isNotNull())
        .groupBy(F.col("uid").alias("extends"))
        .agg(F.min("pos").alias("parent_pos"))
    )
    return lookup_large(classes, first, ["extends"], ["pos"])


def overrides(classes: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields whose type differs from the field of that name in the parent class.

    Of equally named parent fields the last counts. Classes and fields meet on
    the class place, children and parent fields on (parent place, name); either
    may be hot and is split.
    """
    linked = parents_of(classes).filter(F.col("parent_pos").isNotNull())
    child = lookup_large(
        fields.select("class_pos", "pos", "name", F.col("type").alias("child_type")),
        linked.select(F.col("pos").alias("class_pos"), "uid", "extends", "parent_pos"),
        ["class_pos"],
        ["pos"],
        how="inner",
    )
    parent = fields.groupBy(F.col("class_pos").alias("parent_pos"), "name").agg(
        F.max_by("type", "pos").alias("parent_type")
    )
    return lookup_large(child, parent, ["parent_pos", "name"], ["pos"], how="inner").filter(
        ~F.col("child_type").eqNullSafe(F.col("parent_type"))
    ).select("uid", "extends", "pos", F.col("name").alias("field"), "parent_type", "child_type")


def inheritance_issues(classes: DataFrame, fields: DataFrame, strict: bool = False) -> DataFrame:
    """(type, severity, message, details) of missing parents and changed field types."""
    details = "struct<field:string,parent_type:string,child_type:string>"
    missing = broken_parents(classes, strict).select(
        F.lit("missing_parent").alias("type"),
        F.concat(
            F.lit("Parent class "), _text("extends"), F.lit(" not found for "), _text("uid")
        ).alias("message"),
        F.lit(None).cast(details).alias("details"),
    )
    changed = overrides(classes, fields).select(
        F.lit("invalid_override").alias("type"),
        F.concat(F.lit("Invalid field override in "), _text("uid")).alias("message"),
        F.struct("field", "parent_type", "child_type").alias("details"),
    )
    return missing.unionByName(changed).select(
        "type", F.lit("error").alias("severity"), "message", "details"
    )


def enum_issues(fields: DataFrame) -> DataFrame:
    """Later enum fields whose set of values differs from the first definition of that enum."""
    enums = fields.filter((F.col("type") == "enum") & (F.col("enum_name") != "")).withColumn(
        "_set", F.array_sort(F.array_distinct(F.coalesce("values", F.expr("array()"))))
    )
    first = enums.groupBy("enum_name").agg(
        F.min_by("_set", "pos").alias("existing_values"), F.min("pos").alias("_first")
    )
    return (
        lookup_large(enums, first, ["enum_name"], ["pos"], how="inner")
        .filter((F.col("pos") != F.col("_first")) & (F.col("_set") != F.col("existing_values")))
        .select(
            F.lit("inconsistent_enum").alias("type"),
            F.lit("warning").alias("severity"),
            F.concat(F.lit("Inconsistent values for enum "), F.col("enum_name")).alias("message"),
            F.struct(
                "existing_values",
                F.col("_set").alias("new_values"),
                F.col("class_uid").cast("string").alias("class"),
                F.col("name").alias("field"),
            ).alias("details"),
            "enum_name",
            "pos",
        )
    )


def cycles(classes: DataFrame) -> DataFrame:
    """(cycle_id, uid, extends, cycle_size, step): one row per class on an inheritance cycle.

    The rows of a cycle by ``step`` are its path along ``extends``, from its least
    class on. The place of a class is found by cutting the cycle behind that class.
    """
    members = cut_lineage(cycle_members(ancestor_chains(class_links(classes, "uid"))))
    sizes = members.groupBy("cycle_id").agg(F.count(F.lit(1)).alias("cycle_size"))
    cut = members.select("node", F.when(F.col("node") != F.col("cycle_id"), F.col("parent")).alias("parent"))
    far = ancestor_chains(cut).select("node", "hops")
    sized = lookup_large(members, sizes, ["cycle_id"], ["node"], how="inner").join(far, "node")
    return sized.select(
        "cycle_id",
        F.col("node").alias("uid"),
        F.col("parent").alias("extends"),
        "cycle_size",
        ((F.col("cycle_size") - F.col("hops")) % F.col("cycle_size")).alias("step"),
    )


def cycle_issues(classes: DataFrame) -> DataFrame:
    return cycles(classes).select(
        F.lit("circular_dependency").alias("type"),
        F.lit("error").alias("severity"),
        F.concat(
            F.lit("Circular inheritance detected involving class "), F.col("uid").cast("string")
        ).alias("message"),
        "cycle_id",
    )


def verdict(issues: DataFrame) -> DataFrame:
    """One row: whether there are no issues, and how many."""
    return issues.agg(F.count(F.lit(1)).alias("issues")).select(
        (F.col("issues") == 0).alias("valid"), "issues"
    )
