import random

from pyspark.sql import functions as F

from logloom.operators import catalogue_checks as checks
from logloom.operators import catalogue_stats as stats
from logloom.operators.graph import ancestor_chains, connected_components, cycle_members


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(200):03d}", f"n{rng.randrange(200):03d}") for _ in range(150)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    nodes = {n for e in edges for n in e} | {"alone"}
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {n: min(m for m in nodes if find(m) == find(n)) for n in nodes}
    got = connected_components(
        spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "a string, b string")
    )
    assert {r.node: r.component for r in got.collect()} == want
    rounds = connected_components(
        spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "a string, b string"), local=0
    )
    assert {r.node: r.component for r in rounds.collect()} == want


def test_a_hub_of_most_edges_is_split(spark, monkeypatch):
    from logloom.functions import spread
    from logloom.operators import graph

    monkeypatch.setattr(spread, "HOT_ROWS", 100)
    edges = spark.range(1, 3000).selectExpr("0L AS a", "id AS b").unionByName(spark.range(1, 300).selectExpr("-id AS a", "-id - 1 AS b"))
    stars = edges.selectExpr("greatest(a, b) AS v", "least(a, b) AS m")
    plan = graph._large_star(stars)._jdf.queryExecution().analyzed().toString()
    # the hub's edges are dealt to as many parts as there are partitions
    assert "_part" in plan and "_hot" in plan
    nodes = spark.range(-300, 3000).withColumnRenamed("id", "node")
    for local in (None, 0):
        got = {r.node: r.component for r in connected_components(nodes, edges, local).collect()}
        assert got == {n: 0 if n >= 0 else -300 for n in range(-300, 3000)}


def test_chains(spark):
    rng = random.Random(6)
    links = {f"n{i:03d}": (f"n{rng.randrange(i):03d}" if i else None) for i in range(120)}
    links |= {"c1": "c2", "c2": "c3", "c3": "c1", "t1": "c2", "t2": "t1", "self": "self", "m1": "gone", "m2": "m1"}
    links |= {f"l{i:02d}": f"l{(i + 1) % 40:02d}" for i in range(40)}
    frame = spark.createDataFrame(list(links.items()), "node string, parent string")
    chains = ancestor_chains(frame)
    rows = {r.node: r for r in chains.collect()}
    for node in links:
        seen, at, hops = set(), node, 0
        while at in links and links[at] is not None and at not in seen:
            seen.add(at)
            at, hops = links[at], hops + 1
        end = "missing" if at not in links else "root" if links[at] is None else "cycle"
        assert rows[node].end == end, node
        if end != "cycle":
            assert (rows[node]["last"], rows[node].hops) == (at, hops)
    cycles = {}
    for r in cycle_members(chains).collect():
        cycles.setdefault(r.cycle_id, set()).add(r.node)
    assert cycles == {"c1": {"c1", "c2", "c3"}, "self": {"self"}, "l00": {f"l{i:02d}" for i in range(40)}}


def classes(spark, rows):
    return spark.createDataFrame(rows, "pos bigint, uid string, name string, category string, extends string")


def test_depth_by_name_and_defaults(spark):
    frame = classes(
        spark,
        [(0, "1", "base", "x", None), (1, "2", "a", "x", "base"), (2, "3", "b", "y", "a"), (3, "4", "c", "y", ""),
         (4, "5", "loop", "y", "loop"), (5, "6", "lost", "y", "nobody")],
    )
    row = stats.inheritance_depth(frame).first()
    assert (row.max_depth, row.reached) == (2, 4)
    counts = stats.class_counts(frame).first()
    assert (counts.total_classes, counts.base_classes, counts.derived_classes) == (6, 2, 4)
    empty = classes(spark, [])
    assert stats.inheritance_depth(empty).first().max_depth == 0
    nothing = stats.category_stats(
        spark.createDataFrame([], "name string, pos bigint"), spark.createDataFrame([], "category string, pos bigint, class_name string")
    ).first()
    assert (nothing.total_categories, nothing.min_classes, nothing.avg_classes) == (0, 0, 0.0)


def test_checks_on_duplicates_and_nulls(spark):
    frame = classes(
        spark,
        [(0, "1", "p", "x", None), (1, "1", "p again", "x", None), (2, "2", "c", "x", "1"), (3, "3", "d", "x", "9")],
    ).withColumn("extends_present", F.col("pos") >= 1)
    fields = spark.createDataFrame(
        [
            (0, "1", 0, "f", "string", None, None), (0, "1", 1, "f", "int", None, None),
            (1, "1", 1_000_000, "f", "uuid", None, None),
            (2, "2", 2_000_000, "f", "string", None, None), (2, "2", 2_000_001, "g", "enum", "e", ["b", "a"]),
            (3, "3", 3_000_000, "g", "enum", "e", ["a", "b", "b"]), (3, "3", 3_000_001, "h", "enum", "e", ["a"]),
            (3, "3", 3_000_002, "i", "enum", "", ["z"]),
        ],
        "class_pos bigint, class_uid string, pos bigint, name string, type string, enum_name string, values array<string>",
    ).withColumn("ref", F.when(F.col("pos") == 0, "7")).withColumn("ref_present", F.col("pos") <= 1)
    issues = checks.inheritance_issues(frame, fields).collect()
    assert sorted(i.message for i in issues) == ["Invalid field override in 2", "Parent class 9 not found for 3"]
    changed = next(i for i in issues if i.type == "invalid_override")
    # the first class with the uid is the parent, and its last field of that name counts
    assert (changed.details.parent_type, changed.details.child_type) == ("int", "string")
    enums = checks.enum_issues(fields).collect()
    assert [(e.details.field, e.details.existing_values, e.details.new_values) for e in enums] == [("h", ["a", "b"], ["a"])]
    lenient = {r.message for r in checks.reference_issues(frame, fields).collect()}
    assert lenient == {"Class 3 extends non-existent class 9", "Field f references non-existent class 7"}
    strict = {r.message for r in checks.reference_issues(frame, fields, strict=True).collect()}
    assert strict == lenient | {"Class 1 extends non-existent class None", "Field f references non-existent class None"}
    assert checks.verdict(checks.enum_issues(fields)).first().valid is False
