"""Joins of records to the rules of their class."""

from logloom.operators import schemas as s


def test_rules_of_a_class_with_most_records_are_not_sorted_for(spark):
    records = spark.range(50).selectExpr("id AS record_id", "1L AS class_uid", "parse_json('{\"a\": 1}') AS doc")
    rules = spark.createDataFrame([(1, '{"properties": {"a": {"maximum": 0}}}')], "class_uid long, schema string")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        found = s.check_records(records, rules)
        assert "SortMergeJoin [class_uid" not in found._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r.violations) for r in found.collect()} == {("$.a: maximum 0.0",)}
    finally:
        spark.conf.set(name, before)
