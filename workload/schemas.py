"""Validation of nested records, made of orders and their lines, against JSON Schema documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.schemas import check_records
from workload.inputs import tables

LINE = {
    "type": "object",
    "required": ["quantity", "part"],
    "properties": {
        "quantity": {"type": "number", "minimum": 5},
        "flag": {"enum": ["R", "N"]},
        "part": {"$ref": "#/$defs/part"},
    },
}
WHOLE = {
    "type": "object",
    "required": ["order", "lines", "note"],
    "additionalProperties": False,
    "properties": {
        "order": {"$ref": "#/$defs/order"},
        "lines": {"type": "array", "minItems": 2, "items": {"$ref": "#/$defs/line"}},
        "note": {"type": "string", "maxLength": 9},
    },
    "$defs": {
        "line": LINE,
        "part": {"type": "object", "properties": {"size": {"type": "integer", "maximum": 45}}},
        "order": {
            "properties": {"status": {"enum": ["O", "F"]}, "priority": {"pattern": "^[1-3]-"}, "total": {"maximum": 200000}}
        },
    },
}
CHOICES = {
    "allOf": [{"$ref": "#/$defs/lines"}],
    "not": {"properties": {"order": {"properties": {"status": {"const": "P"}}}}},
    "$defs": {
        "lines": {
            "properties": {
                "lines": {
                    "items": {
                        "anyOf": [
                            {"properties": {"quantity": {"maximum": 10}}},
                            {"properties": {"flag": {"const": "N"}}},
                            {"properties": {"part": {"properties": {"size": {"type": "integer", "minimum": 40}}}}},
                        ]
                    }
                }
            }
        }
    },
}


def order_records(spark, path) -> DataFrame:
    """(record_id, class_uid, doc): an order with the list of its lines, each with its part."""
    given = tables(spark, path)
    lines = given["lineitem"].join(given["part"], F.col("l_partkey") == F.col("p_partkey"))
    line = F.struct(
        F.col("l_linenumber").alias("number"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"),
        F.struct(F.col("p_size").alias("size"), F.col("p_type").alias("type")).alias("part"),
    )
    lists = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rows = given["orders"].join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    record = F.struct(
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total")).alias("order"),
        F.coalesce("lines", F.array().cast(lists.schema["lines"].dataType)).alias("lines"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("note "), F.col("o_orderkey"))).alias("note"),
        F.when(F.col("o_orderkey") % 10 == 0, F.lit(1)).alias("extra"),
    )
    return rows.select(
        F.col("o_orderkey").alias("record_id"), (F.col("o_orderkey") % 3 + 2001).alias("class_uid"), F.parse_json(F.to_json(record)).alias("doc")
    )


def checked_records(spark, path):
    """Orders of two classes with a schema, and of one without."""
    schemas = spark.createDataFrame([(2001, json.dumps(WHOLE)), (2002, json.dumps(CHOICES))], "class_uid long, schema string")
    rows = check_records(order_records(spark, path), schemas)
    return rows.select("record_id", "class_uid", "valid", F.concat_ws("; ", "violations").alias("violations"))


CHECKED = """
WITH o AS (SELECT *, o_orderkey % 3 + 2001 AS class_uid FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, p_size, p_type) - 1 AS place
  FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT l_orderkey, count(*) AS n FROM l GROUP BY 1),
v AS (
  SELECT o_orderkey, '$: note required' AS t FROM o WHERE class_uid = 2001 AND o_orderkey % 4 <> 0
  UNION ALL SELECT o_orderkey, '$.note: maxLength 9.0' FROM o WHERE class_uid = 2001 AND o_orderkey % 4 = 0 AND o_orderkey > 9999
  UNION ALL SELECT o_orderkey, '$: unknown extra' FROM o WHERE class_uid = 2001 AND o_orderkey % 10 = 0
  UNION ALL SELECT o_orderkey, '$.order.status: value not allowed' FROM o WHERE class_uid = 2001 AND o_orderstatus NOT IN ('O', 'F')
  UNION ALL SELECT o_orderkey, '$.order.priority: does not match ^[1-3]-' FROM o WHERE class_uid = 2001 AND o_orderpriority[1] NOT IN ('1', '2', '3')
  UNION ALL SELECT o_orderkey, '$.order.total: maximum 200000.0' FROM o WHERE class_uid = 2001 AND o_totalprice > 200000
  UNION ALL SELECT o_orderkey, '$.lines: minItems 2.0' FROM o LEFT JOIN n ON l_orderkey = o_orderkey WHERE class_uid = 2001 AND coalesce(n, 0) < 2
  UNION ALL SELECT o_orderkey, concat('$.lines[', place, '].quantity: minimum 5.0') FROM o JOIN l ON l_orderkey = o_orderkey WHERE class_uid = 2001 AND l_quantity < 5
  UNION ALL SELECT o_orderkey, concat('$.lines[', place, '].flag: value not allowed') FROM o JOIN l ON l_orderkey = o_orderkey WHERE class_uid = 2001 AND l_returnflag NOT IN ('R', 'N')
  UNION ALL SELECT o_orderkey, concat('$.lines[', place, '].part.size: maximum 45.0') FROM o JOIN l ON l_orderkey = o_orderkey WHERE class_uid = 2001 AND p_size > 45
  UNION ALL SELECT o_orderkey, concat('$.lines[', place, ']: matches none of the alternatives') FROM o JOIN l ON l_orderkey = o_orderkey
    WHERE class_uid = 2002 AND l_quantity > 10 AND l_returnflag <> 'N' AND p_size < 40
  UNION ALL SELECT o_orderkey, '$: matches what it must not' FROM o WHERE class_uid = 2002 AND o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'no schema for class 2003' FROM o WHERE class_uid = 2003),
a AS (SELECT o_orderkey, string_agg(t, '; ' ORDER BY t) AS t FROM v GROUP BY 1)
SELECT o.o_orderkey AS record_id, class_uid, t IS NULL AS valid, coalesce(t, '') AS violations FROM o LEFT JOIN a ON a.o_orderkey = o.o_orderkey"""


ENTRIES = {"checked_records": (checked_records, CHECKED)}
