"""Queries over schema catalogues: statistics, checks, documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators import catalogue_checks as checks
from logloom.operators import catalogue_docs as docs
from logloom.operators import catalogue_stats as stats
from logloom.session import scratch_path
from logloom.sources import catalogue as source
from logloom.sources.members import members
from workload.inputs import BASE_FIELDS, CATEGORIES, CLASSES, FIELDS, PAIRED_FIELDS, view

def classes(spark, path) -> DataFrame:
    return view(spark, path, CLASSES)


def fields(spark, path) -> DataFrame:
    return view(spark, path, FIELDS).withColumn(
        "values", F.when(F.col("enum_value").isNotNull(), F.array("enum_value"))
    )


def categories(spark, path) -> DataFrame:
    return view(spark, path, CATEGORIES)


def category_classes(spark, path) -> DataFrame:
    return classes(spark, path).select("category", "pos", F.col("name").alias("class_name"))


def base_fields(spark, path) -> DataFrame:
    """Base-event documents of one entry each, through the JSON loader."""
    rows = view(spark, path, BASE_FIELDS)
    entry = F.create_map(
        "name", F.struct("type_name", F.col("grp").alias("group"), "requirement")
    )
    text = rows.select(
        F.col("entry").cast("string").alias("path"),
        F.to_json(F.struct(F.array(entry).alias("attributes"))).alias("raw"),
    )
    return source.base_fields(text).drop("entry", "pos").join(
        rows.select("entry", "pos", "name"), ["name"]
    )


# Class documents: every order is a class of two fields, its customer's segment the category.
CLASS_DOCS = """
SELECT o_orderkey AS n, o_custkey, o_orderstatus, o_orderpriority FROM orders
"""


def class_documents(spark, path) -> DataFrame:
    rows = view(spark, path, CLASS_DOCS)
    n = F.col("n")
    text = F.to_json(
        F.struct(
            n.alias("uid"),
            F.when(n % 7 != 0, F.concat(F.lit("Class "), n)).alias("caption"),
            F.when(n % 5 != 0, F.concat(F.lit("about "), n)).alias("description"),
            F.when(n % 3 == 0, F.lit("2.1.0")).alias("version"),
            F.when(n % 4 == 0, F.concat(F.lit("p"), n % 10)).alias("extends"),
            F.when(n % 6 != 0, F.col("o_orderstatus")).alias("category"),
            F.when(n % 2 == 0, F.array(F.lit("host"), F.lit("user"))).alias("profiles"),
            F.array(
                F.struct(
                    F.lit("status").alias("name"), F.lit("enum").alias("type"),
                    F.array(F.lit("open"), F.col("o_orderstatus")).alias("values"),
                    F.lit(True).alias("required"), F.lit(None).cast("string").alias("example"),
                ),
                F.struct(
                    F.concat(F.lit("f"), n % 10).alias("name"), F.col("o_orderpriority").alias("type"),
                    F.lit(None).cast("array<string>").alias("values"),
                    F.when(n % 9 == 0, F.lit(False)).alias("required"), n.cast("string").alias("example"),
                ),
            ).alias("fields"),
        )
    )
    named = F.concat(F.lit('{"attributes":{"c'), n.cast("string"), F.lit('":'), text, F.lit("}}"))
    raw = F.when(n % 2 == 0, named).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return rows.select(n.cast("string").alias("path"), raw.alias("raw"))


def class_table(spark, path) -> DataFrame:
    return source.classes(class_documents(spark, path))


def class_documentation(spark, path):
    rows = docs.class_docs(class_table(spark, path))
    first, second = F.col("fields")[0], F.col("fields")[1]
    return rows.select(
        "uid", "title", "description", "version",
        F.col("relationships.extends").alias("extends"),
        F.size("fields").alias("n_fields"),
        F.concat_ws(",", first["enum_values"]).alias("enum_values"),
        second["enum_values"].isNull().alias("no_enum"),
        second["name"].alias("field"),
        second["required"].alias("required"),
        second["example"].alias("example"),
    )


CLASS_DOCUMENTATION = f"""
SELECT CAST(n AS VARCHAR) AS uid, CASE WHEN n % 7 <> 0 THEN concat('Class ', n) ELSE '' END AS title,
  CASE WHEN n % 5 <> 0 THEN concat('about ', n) ELSE '' END AS description,
  CASE WHEN n % 3 = 0 THEN '2.1.0' ELSE '' END AS version,
  CASE WHEN n % 4 = 0 THEN concat('p', n % 10) END AS extends,
  CAST(2 AS INTEGER) AS n_fields, concat('open,', o_orderstatus) AS enum_values, true AS no_enum,
  concat('f', n % 10) AS field, false AS required, CAST(n AS VARCHAR) AS example
FROM ({CLASS_DOCS}) d
"""


def one_class_documentation(spark, path):
    """The documentation of the class with the least uid of the catalogue."""
    table = class_table(spark, path)
    least = table.agg(F.min(F.col("uid").cast("bigint"))).first()[0]
    return docs.class_docs(table, least).select("uid", "title", "version", F.size("fields").alias("n_fields"))


ONE_CLASS = f"SELECT uid, title, version, n_fields FROM ({CLASS_DOCUMENTATION}) c WHERE CAST(uid AS BIGINT) = (SELECT min(o_orderkey) FROM orders)"


def class_rows(spark, path):
    """Classes with the defaults of the summary, from JSON in two shapes."""
    return class_table(spark, path).select(
        "uid", "name", "description", F.coalesce("version", F.lit("1.0.0")).alias("version"), "extends",
        "category", "category_key", F.size("profiles").alias("profile_count"),
    )


CLASS_ROWS = f"""
SELECT CAST(n AS VARCHAR) AS uid, CASE WHEN n % 2 = 0 THEN concat('c', n) ELSE 'unnamed' END AS name,
  CASE WHEN n % 5 <> 0 THEN concat('about ', n) ELSE '' END AS description,
  CASE WHEN n % 3 = 0 THEN '2.1.0' ELSE '1.0.0' END AS version,
  CASE WHEN n % 4 = 0 THEN concat('p', n % 10) END AS extends,
  CASE WHEN n % 6 <> 0 THEN o_orderstatus ELSE 'unknown' END AS category,
  CASE WHEN n % 6 <> 0 THEN o_orderstatus ELSE 'unknown' END AS category_key,
  CASE WHEN n % 2 = 0 THEN 2 ELSE 0 END AS profile_count
FROM ({CLASS_DOCS}) d
"""


def class_fields(spark, path):
    rows = source.fields(class_table(spark, path))
    return docs.format_fields(rows).select(
        "class_uid", "name", "type", "required", "example", F.concat_ws(",", "enum_values").alias("enum_values")
    )


CLASS_FIELDS = f"""
SELECT CAST(n AS VARCHAR) AS class_uid, 'status' AS name, 'enum' AS type, true AS required, NULL AS example, concat('open,', o_orderstatus) AS enum_values FROM ({CLASS_DOCS}) d
UNION ALL
SELECT CAST(n AS VARCHAR), concat('f', n % 10), o_orderpriority, false, CAST(n AS VARCHAR), '' FROM ({CLASS_DOCS}) d
"""


def formatted_fields(spark, path):
    return docs.format_fields(fields(spark, path)).select(
        "class_uid", "pos", "name", "type", "required", "default", "example",
        F.concat_ws(",", "enum_values").alias("enum_values"), F.col("enum_values").isNull().alias("plain"),
    )


FORMATTED = f"""
SELECT class_uid, pos, name, type, required, CAST(NULL AS VARCHAR) AS "default", example,
  coalesce(enum_value, '') AS enum_values, type <> 'enum' AS plain FROM ({FIELDS}) f
"""


def catalogue_tables(spark, path):
    """Catalogue documents landed as files, loaded, written as tables, read back as a bundle."""
    out = scratch_path(spark, "catalogue")
    named = F.col("raw").startswith("{")
    inner = F.when(named, F.expr("substr(raw, 16, length(raw) - 17)")).otherwise(F.expr("substr(raw, 2, length(raw) - 2)"))
    body = F.array_join(F.sort_array(F.collect_list("inner")), ",")
    files = (
        class_documents(spark, path)
        .withColumn("inner", inner)
        .groupBy(F.floor(F.col("path").cast("bigint") / 1000).alias("thousand"), named.alias("named"))
        .agg(body.alias("body"))
        .select(
            (F.col("thousand") * 2 + F.col("named").cast("int")).alias("file"),
            F.when(F.col("named"), F.concat(F.lit('{"attributes":{'), F.col("body"), F.lit("}}")))
            .otherwise(F.concat(F.lit("["), F.col("body"), F.lit("]")))
            .alias("text"),
        )
    )
    # the first document holds its JSON in a string
    in_string = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('\\"')), F.lit('"'))
    files.withColumn("text", F.when(F.col("file") == 0, in_string).otherwise(F.col("text"))).write.partitionBy(
        "file"
    ).text(f"{out}/classes")
    segments = classes(spark, path).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    segments.select(
        F.to_json(F.struct(F.create_map("category", F.struct(F.create_map(F.lit("x"), F.struct("n")).alias("classes"))).alias("attributes"))).alias("text"),
        "category",
    ).write.partitionBy("category").text(f"{out}/categories")
    view(spark, path, BASE_FIELDS).groupBy(F.floor(F.col("entry") / 1000).alias("file")).agg(
        F.to_json(F.struct(F.collect_list(F.create_map("name", F.struct("type_name", "requirement"))).alias("attributes"))).alias("text")
    ).write.partitionBy("file").text(f"{out}/base")
    source.land(spark, f"{out}/categories/*/*.txt", f"{out}/classes/*/*.txt", f"{out}/base/*/*.txt", f"{out}/tables")
    bundle = source.load(spark, f"{out}/tables")
    shown = {
        "categories": ["name"],
        "category_classes": ["category", "class_name"],
        "classes": ["uid", "name", "description", "extends", "category"],
        "fields": ["class_uid", "name", "type", "example"],
        "base_fields": ["name", "type_name", "requirement"],
    }
    items = None
    for name, columns in shown.items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
        rows = bundle[name].select(F.lit(name).alias("table"), text.alias("item"))
        items = rows if items is None else items.unionByName(rows)
    return items


CATALOGUE_TABLES = f"""
SELECT 'categories' AS "table", c_mktsegment AS item FROM (SELECT DISTINCT c_mktsegment FROM customer) s
UNION ALL SELECT 'category_classes', concat(c_mktsegment, '|x') FROM (SELECT DISTINCT c_mktsegment FROM customer) s
UNION ALL SELECT 'classes', concat_ws('|', uid, name, description, coalesce(extends, '-'), category) FROM ({CLASS_ROWS}) c
UNION ALL SELECT 'fields', concat_ws('|', class_uid, name, type, coalesce(example, '-')) FROM ({CLASS_FIELDS}) f
UNION ALL SELECT 'base_fields', concat_ws('|', name, type_name, coalesce(requirement, 'optional')) FROM ({BASE_FIELDS}) b
"""


def catalogue_members(spark, path):
    """All classes in two documents, a list and an object, landed a member a line and read member by member."""
    out = scratch_path(spark, "members")
    named = F.col("raw").startswith("{")
    inner = F.when(named, F.expr("substr(raw, 16, length(raw) - 17)")).otherwise(F.expr("substr(raw, 2, length(raw) - 2)"))
    lines = class_documents(spark, path).select(named.alias("named"), F.lit(1).alias("part"), F.col("path").cast("bigint").alias("n"), inner.alias("text"))
    first = lines.groupBy("named", "part").agg(F.min("n").alias("n"))
    lines = lines.join(first.withColumn("first", F.lit(True)), ["named", "part", "n"], "left")
    lines = lines.withColumn("text", F.when(F.col("first"), F.col("text")).otherwise(F.concat(F.lit(","), "text"))).drop("first")
    ends = first.select("named", F.explode(F.array(F.lit(0), F.lit(2))).alias("part"), "n")
    opened = F.when(F.col("named"), '{"attributes": {').otherwise("[")
    closed = F.when(F.col("named"), '}, "version": "1.0"}').otherwise("]")
    ends = ends.withColumn("text", F.when(F.col("part") == 0, opened).otherwise(closed))
    rows = lines.unionByName(ends.select(*lines.columns)).repartition("named").sortWithinPartitions("named", "part", "n")
    rows.select("named", "text").write.partitionBy("named").text(out)
    return source.classes_of(members(spark, out)).select("uid", "name", "description", "extends", "category", F.size("profiles").alias("n_profiles"))


CATALOGUE_MEMBERS = f"""
SELECT uid, name, description, extends, category, CAST(CASE WHEN CAST(uid AS BIGINT) % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_profiles FROM ({CLASS_ROWS}) c"""


def category_stats(spark, path):
    return stats.category_stats(categories(spark, path), category_classes(spark, path))


SIZES = f"SELECT k.name, k.pos, k.uid, count(c.pos) AS number_of_classes FROM ({CATEGORIES}) k LEFT JOIN ({CLASSES}) c ON c.category = k.name GROUP BY ALL"
CATEGORY_STATS = f"SELECT count(*) AS total_categories, min(number_of_classes) AS min_classes, max(number_of_classes) AS max_classes, avg(number_of_classes) AS avg_classes, CAST(sum(number_of_classes) AS BIGINT) AS total_classes FROM ({SIZES}) s"


def category_summary(spark, path):
    return stats.category_summary(categories(spark, path), category_classes(spark, path))


CATEGORY_SUMMARY = f"SELECT *, row_number() OVER (ORDER BY number_of_classes DESC, pos) AS rank FROM ({SIZES}) s"


def category_class_lists(spark, path):
    return stats.category_class_lists(category_classes(spark, path))


CATEGORY_LISTS = f"SELECT category, row_number() OVER (PARTITION BY category ORDER BY pos) AS ordinal, name AS class_name FROM ({CLASSES}) c"


def category_overview(spark, path):
    """Category documents and the relations between them, from JSON in list form."""
    nations = view(spark, path, "SELECT n_nationkey, n_name, n_regionkey, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
    text = F.to_json(
        F.array(
            F.struct(
                F.col("n_name").alias("caption"), F.col("n_nationkey").alias("uid"),
                F.concat(F.col("suppliers"), F.lit(" suppliers")).alias("description"),
                F.when(F.col("n_regionkey") > 0, F.concat(F.lit("r"), F.col("n_regionkey"))).alias("related_to"),
            )
        )
    )
    table = source.categories(nations.select(F.col("n_name").alias("path"), text.alias("raw")))
    relations = docs.category_relations(table)
    return (
        docs.category_docs(table)
        .join(relations.withColumnRenamed("from", "uid"), ["uid"], "left")
        .select("uid", "name", "description", F.col("to").alias("related"), F.size("fields").alias("n_fields"))
    )


CATEGORY_OVERVIEW = """
SELECT CAST(n_nationkey AS VARCHAR) AS uid, n_name AS name, concat(count(*), ' suppliers') AS description,
  CASE WHEN n_regionkey > 0 THEN concat('r', n_regionkey) END AS related, CAST(0 AS INTEGER) AS n_fields
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name, n_regionkey
"""


def class_counts(spark, path):
    return stats.class_counts(classes(spark, path))


CLASS_COUNTS = f"SELECT count(*) AS total_classes, count(CASE WHEN extends IS NULL THEN 1 END) AS base_classes, count(extends) AS derived_classes FROM ({CLASSES}) c"


def category_distribution(spark, path):
    return stats.category_distribution(classes(spark, path))


DISTRIBUTION = f"SELECT *, row_number() OVER (ORDER BY classes DESC, first_pos) AS rank FROM (SELECT category, count(*) AS classes, min(pos) AS first_pos FROM ({CLASSES}) c GROUP BY category) d"


def class_summary(spark, path):
    return stats.class_summary(classes(spark, path)).select(
        "uid", "name", "version", "extends", "category", "profile_count", "type", "rank"
    )


CLASS_SUMMARY = f"""
SELECT uid, name, '1.0.0' AS version, extends, category, CAST(0 AS INTEGER) AS profile_count,
  CASE WHEN extends IS NULL THEN 'base' ELSE 'derived' END AS type,
  row_number() OVER (ORDER BY category, name, pos) AS rank FROM ({CLASSES}) c
"""


def children(spark, path):
    return stats.children(classes(spark, path))


CHILDREN = f"SELECT extends AS parent, row_number() OVER (PARTITION BY extends ORDER BY pos) AS ordinal, name AS child FROM ({CLASSES}) c WHERE extends IS NOT NULL"


def inheritance_depth(spark, path):
    return stats.inheritance_depth(classes(spark, path), key="uid")


WALK = f"""
WITH RECURSIVE c AS ({CLASSES}), walk(uid, base, depth) AS (
  SELECT uid, uid, CAST(0 AS BIGINT) FROM c WHERE extends IS NULL
  UNION ALL SELECT c.uid, walk.base, walk.depth + 1 FROM c JOIN walk ON c.extends = walk.uid)
"""
DEPTH = f"{WALK} SELECT max(depth) AS max_depth, count(*) AS reached FROM walk"


def class_depths(spark, path):
    return stats.deepest_classes(classes(spark, path), key="uid")


DEPTHS = f"{WALK} SELECT uid, base, depth FROM walk"


def field_stats(spark, path):
    return stats.field_stats(classes(spark, path), fields(spark, path)).select(
        "total_fields", "required_fields",
        F.round("avg_fields_per_class", 6).alias("avg_fields_per_class"),
        F.round("avg_required_fields", 6).alias("avg_required_fields"),
    )


FIELD_STATS = f"""
SELECT n AS total_fields, r AS required_fields, round(n / k, 6) AS avg_fields_per_class, round(r / k, 6) AS avg_required_fields
FROM (SELECT count(*) AS n, count(CASE WHEN required THEN 1 END) AS r FROM ({FIELDS}) f) a, (SELECT count(*) AS k FROM ({CLASSES}) c) b
"""


def field_types(spark, path):
    return stats.field_types(fields(spark, path))


FIELD_TYPES = f"SELECT *, row_number() OVER (ORDER BY fields DESC, first_pos) AS rank FROM (SELECT type, count(*) AS fields, min(pos) AS first_pos FROM ({FIELDS}) f GROUP BY type) d"


def base_event_stats(spark, path):
    return stats.base_event_stats(base_fields(spark, path))


BASE_STATS = f"SELECT count(DISTINCT entry) AS total_base_fields, count(CASE WHEN requirement = 'required' THEN 1 END) AS required_fields, count(CASE WHEN requirement = 'recommended' THEN 1 END) AS recommended_fields FROM ({BASE_FIELDS}) b"


def base_field_types(spark, path):
    return stats.base_field_types(base_fields(spark, path))


BASE_TYPES = f"SELECT *, row_number() OVER (ORDER BY fields DESC, first_pos) AS rank FROM (SELECT type_name, count(*) AS fields, min(pos) AS first_pos FROM ({BASE_FIELDS}) b GROUP BY type_name) d"


def base_field_groups(spark, path):
    return stats.base_field_groups(base_fields(spark, path))


BASE_GROUPS = f"SELECT *, row_number() OVER (ORDER BY fields DESC, first_pos) AS rank FROM (SELECT coalesce(grp, 'uncategorized') AS \"group\", count(*) AS fields, min(pos) AS first_pos FROM ({BASE_FIELDS}) b GROUP BY 1) d"


def base_field_details(spark, path):
    return stats.base_field_details(base_fields(spark, path)).select(
        "name", "type", "type_name", "description", "group", "requirement", "source", "rank"
    )


BASE_DETAILS = f"""
SELECT name, 'unknown' AS type, type_name, '' AS description, coalesce(grp, 'uncategorized') AS "group",
  coalesce(requirement, 'optional') AS requirement, 'unknown' AS source,
  row_number() OVER (ORDER BY coalesce(grp, 'uncategorized'), name, pos) AS rank FROM ({BASE_FIELDS}) b
"""


def broken_parents(spark, path):
    return checks.broken_parents(classes(spark, path)).select("uid", "extends")


BROKEN_PARENTS = f"SELECT uid, extends FROM ({CLASSES}) c WHERE extends IS NOT NULL AND extends NOT IN (SELECT c_custkey FROM customer)"


def broken_refs(spark, path):
    return checks.broken_refs(classes(spark, path), fields(spark, path)).select("class_uid", "pos", "name", "ref")


BROKEN_REFS = f"SELECT class_uid, pos, name, ref FROM ({FIELDS}) f WHERE ref IS NOT NULL AND ref NOT IN (SELECT c_custkey FROM customer)"


def reference_issues(spark, path):
    return checks.reference_issues(classes(spark, path), fields(spark, path))


REFERENCE_ISSUES = f"""
SELECT 'invalid_reference' AS type, 'error' AS severity, concat('Class ', uid, ' extends non-existent class ', extends) AS message FROM ({BROKEN_PARENTS}) p
UNION ALL SELECT 'invalid_reference', 'error', concat('Field ', name, ' references non-existent class ', ref) FROM ({BROKEN_REFS}) r
"""


def reference_verdict(spark, path):
    return checks.verdict(checks.reference_issues(classes(spark, path), fields(spark, path)))


REFERENCE_VERDICT = f"SELECT count(*) = 0 AS valid, count(*) AS issues FROM ({REFERENCE_ISSUES}) i"


def parent_classes(spark, path):
    return checks.parents_of(classes(spark, path)).select("uid", "extends", "parent_pos")


PARENTS = f"SELECT c.uid, c.extends, p.pos AS parent_pos FROM ({CLASSES}) c LEFT JOIN ({CLASSES}) p ON p.uid = c.extends"


def overrides(spark, path):
    return checks.overrides(classes(spark, path), fields(spark, path))


OVERRIDES = f"""
SELECT c.uid, c.extends, f.pos, f.name AS field, p.type AS parent_type, f.type AS child_type
FROM ({FIELDS}) f JOIN ({CLASSES}) c ON c.pos = f.class_pos
JOIN (SELECT class_pos, name, arg_max(type, pos) AS type FROM ({FIELDS}) x GROUP BY ALL) p ON p.class_pos = c.extends AND p.name = f.name
WHERE f.type IS DISTINCT FROM p.type
"""


def inheritance_issues(spark, path):
    return checks.inheritance_issues(classes(spark, path), fields(spark, path)).select(
        "type", "severity", "message", "details.field", "details.parent_type", "details.child_type"
    )


INHERITANCE_ISSUES = f"""
SELECT 'missing_parent' AS type, 'error' AS severity, concat('Parent class ', extends, ' not found for ', uid) AS message,
  NULL AS field, NULL AS parent_type, NULL AS child_type FROM ({BROKEN_PARENTS}) p
UNION ALL SELECT 'invalid_override', 'error', concat('Invalid field override in ', uid), field, parent_type, child_type FROM ({OVERRIDES}) o
"""


def enum_issues(spark, path):
    return checks.enum_issues(fields(spark, path)).select(
        "type", "severity", "message", "enum_name", "pos",
        F.concat_ws(",", "details.existing_values").alias("existing_values"),
        F.concat_ws(",", "details.new_values").alias("new_values"),
        F.col("details.class").alias("class"), F.col("details.field").alias("field"),
    )


ENUM_ISSUES = f"""
WITH e AS (SELECT * FROM ({FIELDS}) f WHERE enum_name IS NOT NULL),
d AS (SELECT enum_name, arg_min(enum_value, pos) AS v, min(pos) AS p FROM e GROUP BY enum_name)
SELECT 'inconsistent_enum' AS type, 'warning' AS severity, concat('Inconsistent values for enum ', e.enum_name) AS message,
  e.enum_name, e.pos, d.v AS existing_values, e.enum_value AS new_values, CAST(e.class_uid AS VARCHAR) AS class, e.name AS field
FROM e JOIN d ON d.enum_name = e.enum_name WHERE e.pos <> d.p AND e.enum_value <> d.v
"""


def inheritance_cycles(spark, path):
    return checks.cycles(classes(spark, path))


# Walks from every class until they return; the planted cycles have two or three classes
WALKS = f"""
c AS ({CLASSES}),
w(start, place, n, low) AS (
  SELECT uid, extends, 1, least(uid, extends) FROM c WHERE extends IS NOT NULL
  UNION ALL SELECT w.start, c.extends, n + 1, least(low, c.extends) FROM w JOIN c ON c.uid = w.place
  WHERE w.place <> w.start AND n < 5 AND c.extends IS NOT NULL),
back AS (SELECT start, n, low FROM w WHERE place = start),
far AS (SELECT back.start, min(w.n) AS k FROM back JOIN w ON w.start = back.start AND w.place = back.low GROUP BY 1)"""
CYCLES = f"""
WITH RECURSIVE {WALKS}
SELECT back.low AS cycle_id, c.uid, c.extends, CAST(back.n AS BIGINT) AS cycle_size, CAST((back.n - far.k % back.n) % back.n AS BIGINT) AS step
FROM back JOIN far USING (start) JOIN c ON c.uid = back.start
"""


def cycle_issues(spark, path):
    return checks.cycle_issues(classes(spark, path)).drop("cycle_id")


CYCLE_ISSUES = f"SELECT 'circular_dependency' AS type, 'error' AS severity, concat('Circular inheritance detected involving class ', uid) AS message FROM ({CYCLES}) x"


def common_fields(spark, path):
    return docs.common_fields(fields(spark, path))


COMMON = f"SELECT name, count(*) AS occurrences, count(DISTINCT type) AS n_types, count(DISTINCT class_uid) AS n_classes FROM ({FIELDS}) f GROUP BY name HAVING count(*) > 1"


def field_type_sets(spark, path):
    return docs.field_type_sets(fields(spark, path))


TYPE_SETS = f"SELECT DISTINCT name, type FROM ({FIELDS}) f"


def field_class_lists(spark, path):
    return docs.field_class_lists(fields(spark, path))


CLASS_LISTS = f"SELECT name, row_number() OVER (PARTITION BY name ORDER BY pos) AS ordinal, class_uid FROM ({FIELDS}) f"


# A document per customer: one class, which extends that of a smaller customer, with an enum and a plain field.
# Documents are ordered by their path, which is the number as text.
FAMILY = """
SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR(20)) AS path,
  CASE WHEN c_custkey > 1 THEN CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS VARCHAR(20)) END AS parent,
  concat('e', CAST(c_custkey % 5 AS VARCHAR(20))) AS enum_name, concat('v', CAST(c_custkey % 3 AS VARCHAR(20))) AS enum_value,
  concat('t', CAST(c_custkey % 7 AS VARCHAR(20))) AS plain_type
FROM customer
"""


def family_classes(spark, path) -> DataFrame:
    rows = view(spark, path, FAMILY)
    enum = F.struct(
        F.lit("state").alias("name"), F.lit("enum").alias("type"), "enum_name", F.array("enum_value").alias("values")
    )
    plain = F.struct(
        F.lit("size").alias("name"), F.col("plain_type").alias("type"), F.lit(None).cast("string").alias("enum_name"),
        F.lit(None).cast("array<string>").alias("values"),
    )
    text = F.to_json(
        F.struct(F.col("path").alias("uid"), F.concat(F.lit("c"), F.col("path")).alias("name"), F.col("parent").alias("extends"), F.array(enum, plain).alias("fields"))
    )
    return source.classes(rows.select("path", text.alias("raw")))


def document_enum_issues(spark, path):
    """Enum definitions compared over many documents."""
    return checks.enum_issues(source.fields(family_classes(spark, path))).select(
        "enum_name", F.col("details.class").alias("class"),
        F.concat_ws(",", "details.existing_values").alias("existing_values"),
        F.concat_ws(",", "details.new_values").alias("new_values"),
    )


DOCUMENT_ENUMS = f"""
WITH f AS ({FAMILY}), d AS (SELECT enum_name, arg_min(enum_value, path) AS v, min(path) AS p FROM f GROUP BY enum_name)
SELECT f.enum_name, f.path AS class, d.v AS existing_values, f.enum_value AS new_values
FROM f JOIN d USING (enum_name) WHERE f.path <> d.p AND f.enum_value <> d.v
"""


def document_overrides(spark, path):
    """Changed field types between classes of different documents."""
    table = family_classes(spark, path)
    return checks.overrides(table, source.fields(table)).select("uid", "extends", "field", "parent_type", "child_type")


DOCUMENT_OVERRIDES = f"""
SELECT c.path AS uid, c.parent AS extends, 'size' AS field, p.plain_type AS parent_type, c.plain_type AS child_type
FROM ({FAMILY}) c JOIN ({FAMILY}) p ON p.path = c.parent WHERE c.plain_type <> p.plain_type
"""


def document_children(spark, path):
    """Children of a class in the order of their documents."""
    return stats.children(family_classes(spark, path))


DOCUMENT_CHILDREN = f"SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY path) AS ordinal, concat('c', path) AS child FROM ({FAMILY}) f WHERE parent IS NOT NULL"


def type_reference(spark, path):
    return docs.type_reference(fields(spark, path))


TYPE_REFERENCE = f"""
SELECT a.type, a.example, b.classes_count FROM
  (SELECT type, arg_min(example, pos) AS example FROM ({FIELDS}) f WHERE example <> '' GROUP BY type) a
  JOIN (SELECT type, count(DISTINCT name) AS classes_count FROM ({FIELDS}) f GROUP BY type) b USING (type)
"""


def usage_patterns(spark, path):
    patterns, members = docs.usage_patterns(view(spark, path, PAIRED_FIELDS))
    return patterns.join(members, ["pattern"])


PATTERNS = f"""
WITH s AS (SELECT name, list(DISTINCT class_uid ORDER BY class_uid) AS classes FROM ({PAIRED_FIELDS}) f GROUP BY name),
p AS (SELECT classes, count(*) AS field_count, min(name) AS pattern, len(classes) AS occurrence_count FROM s WHERE len(classes) > 1 GROUP BY classes HAVING count(*) > 1),
r AS (SELECT *, row_number() OVER (ORDER BY occurrence_count DESC, pattern) AS rank FROM p)
SELECT r.pattern, r.field_count, r.occurrence_count, r.rank, s.name FROM r JOIN s ON s.classes = r.classes
"""


def pattern_classes(spark, path):
    rows = view(spark, path, PAIRED_FIELDS)
    patterns, _ = docs.usage_patterns(rows)
    return docs.pattern_classes(patterns, rows).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("classes"), F.sum("class_uid").alias("uid_sum")
    )


PATTERN_CLASSES = f"SELECT f.name AS pattern, count(DISTINCT class_uid) AS classes, CAST(sum(DISTINCT class_uid) AS BIGINT) AS uid_sum FROM ({PAIRED_FIELDS}) f JOIN (SELECT DISTINCT pattern FROM ({PATTERNS}) p) q ON q.pattern = f.name GROUP BY 1"


ENTRIES = {
    "catalogue_tables": (catalogue_tables, CATALOGUE_TABLES),
    "catalogue_members": (catalogue_members, CATALOGUE_MEMBERS),
    "class_rows": (class_rows, CLASS_ROWS),
    "class_fields": (class_fields, CLASS_FIELDS),
    "formatted_fields": (formatted_fields, FORMATTED),
    "class_documentation": (class_documentation, CLASS_DOCUMENTATION),
    "one_class_documentation": (one_class_documentation, ONE_CLASS),
    "category_stats": (category_stats, CATEGORY_STATS),
    "category_summary": (category_summary, CATEGORY_SUMMARY),
    "category_class_lists": (category_class_lists, CATEGORY_LISTS),
    "category_overview": (category_overview, CATEGORY_OVERVIEW),
    "catalogue_class_counts": (class_counts, CLASS_COUNTS),
    "category_distribution": (category_distribution, DISTRIBUTION),
    "class_summary": (class_summary, CLASS_SUMMARY),
    "children_lists": (children, CHILDREN),
    "inheritance_depth": (inheritance_depth, DEPTH),
    "class_depths": (class_depths, DEPTHS),
    "field_stats": (field_stats, FIELD_STATS),
    "field_types": (field_types, FIELD_TYPES),
    "base_event_stats": (base_event_stats, BASE_STATS),
    "base_field_types": (base_field_types, BASE_TYPES),
    "base_field_groups": (base_field_groups, BASE_GROUPS),
    "base_field_details": (base_field_details, BASE_DETAILS),
    "broken_parents": (broken_parents, BROKEN_PARENTS),
    "broken_refs": (broken_refs, BROKEN_REFS),
    "reference_issues": (reference_issues, REFERENCE_ISSUES),
    "reference_verdict": (reference_verdict, REFERENCE_VERDICT),
    "parent_classes": (parent_classes, PARENTS),
    "field_overrides": (overrides, OVERRIDES),
    "inheritance_issues": (inheritance_issues, INHERITANCE_ISSUES),
    "enum_issues": (enum_issues, ENUM_ISSUES),
    "inheritance_cycles": (inheritance_cycles, CYCLES),
    "cycle_issues": (cycle_issues, CYCLE_ISSUES),
    "common_fields": (common_fields, COMMON),
    "field_type_sets": (field_type_sets, TYPE_SETS),
    "field_class_lists": (field_class_lists, CLASS_LISTS),
    "type_reference": (type_reference, TYPE_REFERENCE),
    "usage_patterns": (usage_patterns, PATTERNS),
    "pattern_classes": (pattern_classes, PATTERN_CLASSES),
    "document_enum_issues": (document_enum_issues, DOCUMENT_ENUMS),
    "document_overrides": (document_overrides, DOCUMENT_OVERRIDES),
    "document_children": (document_children, DOCUMENT_CHILDREN),
}
