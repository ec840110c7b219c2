import random

import pytest

from logloom.operators.collapse import neighbour_marks, superseded

SCHEMA = "id string, dataset_id string, query string, created_at bigint"


def ordered(rows, dataset):
    rows = sorted((r for r in rows if r[1] == dataset), key=lambda r: (r[3], len(r[2].encode()), r[0]))
    return rows, [r[2].strip().lower() for r in rows]


def brute_later(rows, window=10):
    out = set()
    for d in {r[1] for r in rows}:
        rs, qs = ordered(rows, d)
        for i in range(len(rs)):
            if any(rs[j][3] - rs[i][3] <= window and qs[j].startswith(qs[i]) for j in range(i + 1, len(rs))):
                out.add(rs[i][0])
    return out


def brute_neighbours(rows, look=10, window=10):
    out = set()
    for d in {r[1] for r in rows}:
        rs, qs = ordered(rows, d)
        for i in range(len(rs)):
            around = [j for j in range(max(0, i - look), min(len(rs), i + look + 1)) if j != i]
            kin = [j for j in around if qs[j].startswith(qs[i]) or qs[i].startswith(qs[j])]
            near = [j for j in kin if abs(rs[j][3] - rs[i][3]) <= window]
            if any(len(qs[j]) > len(qs[i]) for j in near):
                out.add(rs[i][0])
            elif near:
                out |= {rs[j][0] for j in kin}
    return out


def ids(frame):
    return {r.id for r in frame.collect()}


CASES = {
    "keystrokes": [("1", "d", "a", 0), ("2", "d", "ap", 1), ("3", "d", "app", 2), ("4", "d", "apple", 3)],
    "equal": [("1", "d", "x", 0), ("2", "d", "x", 5)],
    "equal, same second": [("1", "d", "x", 5), ("2", "d", "x", 5), ("3", "d", "x", 5)],
    "ten and eleven seconds": [("1", "d", "a", 0), ("2", "d", "ab", 10), ("3", "e", "a", 0), ("4", "e", "ab", 11)],
    "empty query": [("1", "d", "", 0), ("2", "d", "zzz", 3)],
    "padding and case": [("1", "d", "\t Ab ", 0), ("2", "d", "ABC", 4)],
    "padded longer than its extension": [("1", "d", "a      ", 7), ("2", "d", "ab", 7)],
    "across a block of time": [("1", "d", "a", 3599), ("2", "d", "ab", 3605)],
    "far apart in rows": [("0", "d", "a", 0)] + [(f"x{i:02d}", "d", f"z{i}", 1) for i in range(12)] + [("9", "d", "ab", 2)],
    "interleaved datasets": [("1", "d", "a", 0), ("2", "e", "ab", 1), ("3", "d", "abc", 2), ("4", "e", "abcd", 30)],
}


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, case):
    rows = CASES[case]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert ids(superseded(frame)) == brute_later(rows)
    assert ids(neighbour_marks(frame)) == brute_neighbours(rows)


def test_documented_example(spark):
    frame = spark.createDataFrame(CASES["keystrokes"], SCHEMA)
    assert ids(superseded(frame)) == {"1", "2", "3"}
    equal = spark.createDataFrame(CASES["equal"], SCHEMA)
    assert ids(superseded(equal)) == {"1"}
    assert ids(neighbour_marks(equal)) == {"1", "2"}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [
        (
            f"i{i:04d}",
            "hot" if i % 3 else rng.choice("ab"),
            "".join(rng.choice("ab A") for _ in range(rng.randint(0, 4))),
            rng.randint(3400, 3900),
        )
        for i in range(600)
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert ids(superseded(frame)) == brute_later(rows)
    assert ids(neighbour_marks(frame, block_rows=25)) == brute_neighbours(rows)


def test_block_must_hold_range(spark):
    with pytest.raises(ValueError):
        neighbour_marks(spark.createDataFrame(CASES["equal"], SCHEMA), block_rows=5)


def test_window_over_an_hour(spark):
    rows = [("d", "1", "ap", 0), ("d", "2", "apple", 8000), ("d", "3", "ap", 9001), ("d", "4", "apple pie", 18_002)]
    frame = spark.createDataFrame(rows, "dataset_id string, id string, query string, created_at long")
    assert sorted(r.id for r in superseded(frame, seconds=9000).collect()) == ["1"]
    assert sorted(r.id for r in superseded(frame, seconds=10_002).collect()) == ["1", "2", "3"]
    with pytest.raises(TypeError):
        superseded(frame.withColumn("created_at", frame.created_at.cast("double")))


def test_least_mark_reaches_the_scan(spark, tmp_path, capsys):
    from logloom.sources.searches import since_marks

    rows = [(f"{i}", "a" if i % 2 else "b", "q", 1000 + i, "search", i % 3 == 0) for i in range(100)]
    path = str(tmp_path / "log")
    spark.createDataFrame(rows, "id string, dataset_id string, query string, created_at long, search_type string, dup boolean").selectExpr(
        "*", "CAST(dup AS INT) AS is_duplicate"
    ).drop("dup").write.parquet(path)
    marks = spark.createDataFrame([("a", 1050)], "dataset_id string, last_collapsed long")
    found = since_marks(spark.read.parquet(path), marks)
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(created_at,1050)" in plan
    want = {r[0] for r in rows if (r[1] == "a" and r[3] >= 1050) or (r[1] == "b" and not r[5])}
    assert {r.id for r in found.collect()} == want and found.count() == len(want)


def test_silent_dataset_is_decided(spark, tmp_path):
    from logloom.streaming.collapse import collapse_stream

    path = tmp_path / "in"
    schema = "dataset_id string, id string, query string, created_at long"
    for rows in ([("quiet", "1", "ap", 0), ("loud", "2", "x", 0)], [("loud", "3", "y", 10_000)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    out = str(tmp_path / "out")
    collapse_stream(stream, out, str(tmp_path / "state"), str(tmp_path / "c"), continuous=False).awaitTermination()
    assert {r.id for r in spark.read.parquet(out).collect()} == {"1", "2"}


def test_prefixes_are_shuffled_as_digests(spark):
    from logloom.operators.collapse import superseded

    rows = [("d", "a", "abc", 1), ("d", "b", "abcd", 2)]
    frame = spark.createDataFrame(rows, "dataset_id string, id string, query string, created_at long")
    plan = superseded(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex(md5(" in plan and [tuple(r) for r in superseded(frame).collect()] == [("d", "a")]
