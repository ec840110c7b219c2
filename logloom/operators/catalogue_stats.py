"""Statistics over catalogue tables.

Reports that are ordered carry a ``rank``; it is computed over range
partitions, not by sorting everything in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.spread import listed, lookup_large, with_ordinal
from logloom.operators.graph import ancestor_chains


def category_sizes(categories: DataFrame, category_classes: DataFrame) -> DataFrame:
    """Categories with their number of classes, 0 where there are none."""
    sizes = category_classes.groupBy("category").agg(F.count(F.lit(1)).alias("_n"))
    return categories.join(sizes.withColumnRenamed("category", "name"), ["name"], "left").select(
        *categories.columns, F.coalesce("_n", F.lit(0)).alias("number_of_classes")
    )


def category_stats(categories: DataFrame, category_classes: DataFrame) -> DataFrame:
    n = F.col("number_of_classes")
    return category_sizes(categories, category_classes).agg(
        F.count(F.lit(1)).alias("total_categories"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_classes"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_classes"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_classes"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_classes"),
    )


def category_summary(categories: DataFrame, category_classes: DataFrame) -> DataFrame:
    """Categories by number of classes, largest first; ties in document order."""
    sized = category_sizes(categories, category_classes)
    return with_ordinal(sized, [], [F.desc("number_of_classes"), F.col("pos")], "rank")


def category_class_lists(category_classes: DataFrame) -> DataFrame:
    """(category, ordinal, class_name) in catalogue order."""
    return listed(category_classes, ["category"], "pos", "class_name")


def class_summary(classes: DataFrame) -> DataFrame:
    """Classes with defaults, ranked by category and name."""
    have = set(classes.columns)
    derived = F.coalesce(F.col("extends").cast("string") != "", F.lit(False))

    def column(name: str, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    profiles = F.col("profiles") if "profiles" in have else F.expr("cast(array() as array<string>)")
    rows = classes.select(
        "pos",
        column("name", "unnamed").alias("name"),
        column("description", "").alias("description"),
        "uid",
        column("version", "1.0.0").alias("version"),
        "extends",
        column("category", "unknown").alias("category"),
        profiles.alias("profiles"),
        F.size(profiles).alias("profile_count"),
        F.when(derived, "derived").otherwise("base").alias("type"),
    )
    return with_ordinal(rows, [], [F.col("category"), F.col("name"), F.col("pos")], "rank")


def class_counts(classes: DataFrame) -> DataFrame:
    derived = F.coalesce(F.col("extends").cast("string") != "", F.lit(False))
    return classes.agg(
        F.count(F.lit(1)).alias("total_classes"),
        F.count(F.when(~derived, 1)).alias("base_classes"),
        F.count(F.when(derived, 1)).alias("derived_classes"),
    )


def distribution(frame: DataFrame, key: str, name: str = "classes") -> DataFrame:
    """Count per value, largest first; ties by first appearance."""
    counts = frame.groupBy(key).agg(
        F.count(F.lit(1)).alias(name), F.min("pos").alias("first_pos")
    )
    return with_ordinal(counts, [], [F.desc(name), F.col("first_pos")], "rank")


def category_distribution(classes: DataFrame) -> DataFrame:
    key = "category_key" if "category_key" in classes.columns else "category"
    keyed = classes.withColumn("category", F.coalesce(F.col(key), F.lit("unknown")))
    return distribution(keyed, "category")


def field_stats(classes: DataFrame, fields: DataFrame) -> DataFrame:
    """Totals and means of fields over all classes, also those without fields."""
    total = fields.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("required"), 1)).alias("r")
        )
    ).scalar()
    return classes.agg(F.count(F.lit(1)).alias("_n")).withColumn("_t", total).select(
        F.col("_t.n").alias("total_fields"),
        F.col("_t.r").alias("required_fields"),
        F.coalesce(F.try_divide("_t.n", "_n"), F.lit(0.0)).alias("avg_fields_per_class"),
        F.coalesce(F.try_divide("_t.r", "_n"), F.lit(0.0)).alias("avg_required_fields"),
    )


def field_types(fields: DataFrame) -> DataFrame:
    return distribution(fields, "type", "fields")


def children(classes: DataFrame) -> DataFrame:
    """Inheritance tree as rows (parent, ordinal, child), children in catalogue order."""
    derived = classes.filter(F.col("extends").cast("string") != "")
    return listed(derived.select(F.col("extends").alias("parent"), "pos", F.col("name").alias("child")), ["parent"], "pos", "child")


def class_links(classes: DataFrame, key: str = "name") -> DataFrame:
    """(node, parent) with one row per node: of classes with equal keys the first counts."""
    parent = F.when(F.col("extends").cast("string") != "", F.col("extends"))
    return (
        classes.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("node"))
        .agg(F.min_by(parent, "pos").alias("parent"))
    )


def inheritance_depth(classes: DataFrame, key: str = "name") -> DataFrame:
    """Depth below the base classes: deepest chain and number of classes reached from a base class.

    ``key`` is the column that ``extends`` refers to. Classes on cycles or below
    a missing parent are reached from no base class.
    """
    chains = ancestor_chains(class_links(classes, key)).filter(F.col("end") == "root")
    return chains.agg(
        F.coalesce(F.max("hops"), F.lit(0)).alias("max_depth"),
        F.count(F.lit(1)).alias("reached"),
    )


def base_event_stats(base_fields: DataFrame) -> DataFrame:
    return base_fields.agg(
        F.count_distinct("entry").alias("total_base_fields"),
        F.count(F.when(F.col("requirement") == "required", 1)).alias("required_fields"),
        F.count(F.when(F.col("requirement") == "recommended", 1)).alias("recommended_fields"),
    )


def base_field_types(base_fields: DataFrame) -> DataFrame:
    return distribution(base_fields, "type_name", "fields")


def base_field_groups(base_fields: DataFrame) -> DataFrame:
    return distribution(base_fields, "group", "fields")


def base_field_details(base_fields: DataFrame) -> DataFrame:
    """Fields by group and name."""
    return with_ordinal(base_fields, [], [F.col("group"), F.col("name"), F.col("pos")], "rank")


def deepest_classes(classes: DataFrame, key: str = "name") -> DataFrame:
    """Depth of every class below its base class."""
    chains = ancestor_chains(class_links(classes, key)).filter(F.col("end") == "root")
    return lookup_large(
        classes.withColumnRenamed(key, "node"),
        chains.select("node", "last", "hops"),
        ["node"],
        ["pos"],
        how="inner",
    ).select(F.col("node").alias(key), F.col("last").alias("base"), F.col("hops").alias("depth"))
