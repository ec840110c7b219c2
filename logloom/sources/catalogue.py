"""Event-schema catalogue: JSON documents to tables and back.

Tables: ``categories``, ``category_classes``, ``classes``, ``fields``,
``base_fields``. ``pos`` columns order and name rows over all documents: they are
structs of the document's path and the places within it, compared in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import variant as V

TABLES = ("categories", "category_classes", "classes", "fields", "base_fields")

def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as (path, raw, doc); a file that holds JSON in a string is decoded twice."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), V.unwrap("value").alias("raw"))
        .withColumn("doc", F.try_parse_json("raw"))
    )


def entries(docs: DataFrame) -> DataFrame:
    """Members of a document in order as (path, pos, key, json).

    A document is a list, an object with ``attributes`` (a list or an object),
    or one entry by itself. JSON objects keep their order here, which a VARIANT
    would not.
    """
    staged = docs.withColumn(
        "_inner", F.when(V.starts(F.col("raw"), "{"), F.from_json("raw", "attributes string")["attributes"])
    ).withColumn("_body", F.coalesce("_inner", "raw"))
    named = F.transform(
        F.map_entries(F.from_json("_body", "map<string,string>")),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("json")),
    )
    listed = F.transform(
        F.from_json("_body", "array<string>"),
        lambda e: F.struct(F.lit(None).cast("string").alias("key"), e.alias("json")),
    )
    single = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("raw").alias("json")))
    members = (
        F.when(V.starts(F.col("_body"), "["), listed)
        .when(F.col("_inner").isNotNull(), named)
        .otherwise(single)
    )
    return staged.select("path", F.posexplode(members).alias("place", "_e")).select(
        "path", F.struct("path", F.col("place").cast("bigint").alias("place")).alias("pos"), "_e.key", "_e.json"
    )


def within(pos: str, place: str) -> Column:
    """The position of a part, by its place in the member at ``pos``."""
    return F.struct(f"{pos}.path", f"{pos}.place", F.col(place).cast("bigint").alias("part"))


def categories(docs: DataFrame) -> DataFrame:
    doc = entries(docs).withColumn("doc", F.try_parse_json("json"))
    return doc.select(
        "pos",
        F.coalesce("key", V.get_or("doc", "$.name", "unnamed")).alias("name"),
        V.get("doc", "$.caption").alias("caption"),
        V.get_or("doc", "$.description", "").alias("description"),
        V.get_or("doc", "$.uid", "").alias("uid"),
        V.get_or("doc", "$.type", "").alias("type"),
        V.get("doc", "$.related_to").alias("related_to"),
        "doc",
        "json",
    )


def category_classes(docs: DataFrame) -> DataFrame:
    """(category_pos, category, pos, class_name) from the class map or list of each category."""
    inner = F.from_json("json", "classes string")["classes"]
    names = F.when(V.starts(F.col("_c"), "{"), F.map_keys(F.from_json("_c", "map<string,string>"))).when(
        V.starts(F.col("_c"), "["), F.from_json("_c", "array<string>")
    )
    return (
        categories(docs)
        .select(F.col("pos").alias("category_pos"), F.col("name").alias("category"), inner.alias("_c"))
        .select("category_pos", "category", F.posexplode(names).alias("_i", "class_name"))
        .select("category_pos", "category", within("category_pos", "_i").alias("pos"), "class_name")
    )


def classes(docs: DataFrame) -> DataFrame:
    return classes_of(entries(docs))


def classes_of(members: DataFrame) -> DataFrame:
    """Class rows of members, as :func:`entries` or, for documents of any size, ``members.members`` gives them."""
    doc = members.withColumn("doc", F.try_parse_json("json"))
    profiles = F.coalesce(V.get("doc", "$.profiles", "array<string>"), F.expr("array()"))
    return doc.select(
        "pos",
        V.get("doc", "$.uid").alias("uid"),
        F.coalesce("key", V.get_or("doc", "$.name", "unnamed")).alias("name"),
        V.get_or("doc", "$.caption", "").alias("caption"),
        V.get_or("doc", "$.description", "").alias("description"),
        V.get("doc", "$.version").alias("version"),
        V.get("doc", "$.extends").alias("extends"),
        (~V.is_missing("doc", "$.extends")).alias("extends_present"),
        V.get_or("doc", "$.category", "unknown").alias("category"),
        V.get_or("doc", "$.category_name", V.get_or("doc", "$.category", "unknown")).alias("category_key"),
        profiles.alias("profiles"),
        V.get("doc", "$.examples", "array<variant>").alias("examples"),
        "doc",
    )


def fields(class_table: DataFrame) -> DataFrame:
    """One row per field; ``pos`` orders fields over all documents."""
    exploded = class_table.select(
        F.col("pos").alias("class_pos"),
        F.col("uid").alias("class_uid"),
        F.posexplode(V.get("doc", "$.fields", "array<variant>")).alias("_i", "f"),
    )
    return exploded.select(
        "class_pos",
        "class_uid",
        within("class_pos", "_i").alias("pos"),
        *_field_columns("f"),
    )


def _field_columns(f: str) -> list[Column]:
    return [
        V.get(f, "$.name").alias("name"),
        V.get(f, "$.type").alias("type"),
        V.get_or(f, "$.description", "").alias("description"),
        V.get_or(f, "$.required", False, "boolean").alias("required"),
        V.get(f, "$.default").alias("default"),
        F.coalesce(V.get(f, "$.values", "array<string>"), F.expr("array()")).alias("values"),
        V.get(f, "$.enum_name").alias("enum_name"),
        V.get(f, "$.ref").alias("ref"),
        (~V.is_missing(f, "$.ref")).alias("ref_present"),
        V.get(f, "$.example").alias("example"),
    ]


def base_fields(docs: DataFrame) -> DataFrame:
    """Base-event fields with defaults: each entry holds one field under its name."""
    member = entries(docs).select(
        F.col("pos").alias("entry"), F.posexplode(F.from_json("json", "map<string,string>")).alias("_i", "name", "_json")
    )
    doc = member.withColumn("doc", F.try_parse_json("_json"))
    return doc.select(
        "entry",
        within("entry", "_i").alias("pos"),
        "name",
        V.get_or("doc", "$.type", "unknown").alias("type"),
        V.get_or("doc", "$.type_name", "Unknown").alias("type_name"),
        V.get_or("doc", "$.description", "").alias("description"),
        V.get_or("doc", "$.group", "uncategorized").alias("group"),
        V.get_or("doc", "$.requirement", "optional").alias("requirement"),
        V.get_or("doc", "$._source", "unknown").alias("source"),
    )


def land(
    spark: SparkSession, category_path: str, class_path: str, base_path: str, out: str
) -> dict[str, str]:
    """Write the catalogue documents as Parquet tables below ``out``."""
    category_docs = documents(spark, category_path)
    class_table = classes(documents(spark, class_path))
    frames = {
        "categories": categories(category_docs).drop("doc"),
        "category_classes": category_classes(category_docs),
        "classes": class_table.drop("doc", "examples"),
        "fields": fields(class_table),
        "base_fields": base_fields(documents(spark, base_path)),
    }
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{out}/{name}")
    return {name: f"{out}/{name}" for name in frames}


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The landed tables as one bundle."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
