import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import spread


def test_ordinal_spans_partitions(spark):
    rows = [("hot" if i % 3 else None, i * 7 % 1000, i) for i in range(1000)]
    frame = spark.createDataFrame(rows, "g string, o int, id int")
    got = spread.with_ordinal(frame, ["g"], [F.col("o"), F.col("id")], partitions=7).collect()
    for g in ("hot", None):
        ordered = sorted((r.o, r.id) for r in got if r.g == g)
        assert [r.ordinal for r in sorted((r for r in got if r.g == g), key=lambda r: (r.o, r.id))] == list(
            range(1, len(ordered) + 1)
        )


def test_ordinal_without_group_descending(spark):
    frame = spark.range(100).withColumn("o", F.col("id") % 10)
    got = spread.with_ordinal(frame, [], [F.desc("o"), F.col("id")], "rank").orderBy("rank").collect()
    assert [(r.o, r.id) for r in got] == sorted(((r.o, r.id) for r in got), key=lambda t: (-t[0], t[1]))
    assert [r["rank"] for r in got] == list(range(1, 101))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("large", [False, True])
def test_lookup_equals_join(spark, monkeypatch, how, large):
    monkeypatch.setattr(spread, "HOT_ROWS", 10)
    facts = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    facts = facts.withColumn("k", F.when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.col("k")))
    per_key = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    join = spread.lookup_large if large else spread.lookup
    got = join(facts, per_key, ["k"], ["id"], how)
    want = facts.join(per_key, ["k"], how)
    columns = sorted(want.columns)
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))


def test_first_n(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.randint(0, 50), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, o int, id int")
    got = spread.first_n(frame, ["g"], [F.col("o"), F.col("id")], 20, ["id"]).collect()
    for g in "ab":
        want = sorted((o, i) for gg, o, i in rows if gg == g)[:20]
        assert [(r.o, r.id) for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == want


def test_long_lists_have_one_form(spark):
    n = 120_000
    frame = spark.range(n).select(F.lit("k").alias("k"), F.struct((n - F.col("id")).alias("p")).alias("pos"), F.col("id").alias("v"))
    got = spread.listed(frame, ["k"], "pos", "v")
    assert got.filter(F.col("ordinal") + F.col("v") == n).count() == got.count() == n


def test_latest(spark):
    frame = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "id string, version int, v string"
    )
    got = {r.id: (r.version, r.v) for r in spread.latest(frame, ["id"], ["version"]).collect()}
    assert got == {"a": (3, "z"), "b": (1, None)}
