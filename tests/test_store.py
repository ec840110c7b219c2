import os
import random

import pytest
from pyspark.sql import functions as F

from logloom.sinks.store import KeyedStore
from logloom.sources import searches as source
from logloom.streaming import ingest as stream

SCHEMA = "k string, v bigint, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def store(spark, tmp_path, buckets=8):
    return KeyedStore(spark, f"{tmp_path}/store", SCHEMA, ["k"], ["v"], ["text"], buckets)


def rows_of(found):
    return sorted(map(tuple, found.collect()), key=str)


def folders(path):
    return sorted(d for d in os.listdir(path) if "=" in d)


def test_store_against_a_dict(spark, tmp_path):
    """Random changes, deletions, compactions and clean-ups, beside a plain dict."""
    rng = random.Random(5)
    keys = [None, "", *[f"k{i}" for i in range(12)]]
    kept = store(spark, tmp_path)

    def draw(n):
        return [(rng.choice(keys), rng.randrange(3), rng.choice("abc")) for _ in range(n)]

    def put(state, rows, batch):
        for k, v, text in rows:
            state[k] = max(state.get(k, (-1, -1, "")), (v, batch, text))

    state, first = {}, draw(10)
    put(state, first, 0)
    kept.create(frame(spark, first))
    for batch in range(1, 9):
        if batch in (3, 6):
            gone = rng.sample(keys, 4)
            for k in gone:
                state.pop(k, None)
            # extra columns of the keys are not read
            kept.delete(spark.createDataFrame([(k, 1) for k in gone], "k string, more int"), batch)
        else:
            some = draw(6)
            put(state, some, batch)
            kept.upsert(frame(spark, some), batch)
        if batch in (4, 7):
            kept.compact(batch)
            # versions that are level now are told apart by their text, as those of the first rows
            state = {k: (v, 0, text) for k, (v, _, text) in state.items()}
        if batch == 5:
            kept.vacuum()
        assert rows_of(kept.read()) == sorted([(k, v, text) for k, (v, _, text) in state.items()], key=str), batch


def test_store_touches_only_buckets_of_changed_keys(spark, tmp_path):
    kept = store(spark, tmp_path)
    kept.create(frame(spark, [(f"k{i}", 1, "a") for i in range(200)]))
    assert len(folders(f"{tmp_path}/store/base/generation=0")) == 8
    kept.upsert(frame(spark, [("k7", 2, "b")] * 50), 1)
    touched = folders(f"{tmp_path}/store/delta/batch=1")
    assert len(touched) == 1
    one = kept.read(spark.createDataFrame([("k7",)], "k string"))
    assert rows_of(one) == [("k7", 2, "b")]
    files = {r.f for r in kept._base(kept._state(), kept._found(one.select(kept._bucket().alias("bucket")))).select(F.col("_metadata.file_path").alias("f")).collect()}
    assert files and all(f"generation=0/{touched[0]}/" in f for f in files)
    assert [f"bucket={b}" for b in kept.compact(1)] == touched == folders(f"{tmp_path}/store/base/generation=1")
    assert kept.compact(1) == [] and kept.read().count() == 200
    kept.vacuum()
    # the other buckets are still those of the first generation
    assert folders(f"{tmp_path}/store/base") == ["generation=0", "generation=1"] and kept.read().count() == 200


def test_store_passes_over_what_was_not_written_to_the_end(spark, tmp_path):
    kept = store(spark, tmp_path)
    kept.create(frame(spark, [("a", 1, "x")]))
    kept.upsert(frame(spark, [("a", 2, "y"), ("b", 1, "z")]), 1)
    os.rename(f"{tmp_path}/store/delta/batch=1/_SUCCESS", f"{tmp_path}/half")
    assert rows_of(kept.read()) == [("a", 1, "x")] and kept.compact(1) == []
    kept.upsert(frame(spark, [("a", 2, "y"), ("b", 1, "z")]), 1)
    # a compaction that died before its manifest leaves a generation that nothing names
    kept._write(frame(spark, [("c", 9, "w")]), "base/generation=1")
    assert rows_of(kept.read()) == [("a", 2, "y"), ("b", 1, "z")]
    kept.compact(1)
    assert rows_of(kept.read()) == [("a", 2, "y"), ("b", 1, "z")]


def test_empty_store(spark, tmp_path):
    kept = store(spark, tmp_path)
    kept.create(frame(spark, []))
    assert kept.read().count() == 0 and kept.compact(5) == []
    kept.delete(spark.createDataFrame([("a",)], "k string"), 6)
    kept.upsert(frame(spark, [("a", 1, "x")]), 7)
    assert rows_of(kept.read()) == [("a", 1, "x")]


DAY = 86_400


def search_log(spark):
    # ds0 ran on day 1, ds1 on day 8, ds2 never
    rows = [
        (f"{d}-{day}-{h}", "q", 0.5, day * DAY + h * 3600, "rag" if h == 23 else "search", 0, f"ds{d}")
        for d in range(3) for day in range(10) for h in (0, 11, 12, 23)
    ]
    schema = "id string, query string, top_score double, created_at bigint, search_type string, is_duplicate int, dataset_id string"
    return spark.createDataFrame(rows, schema)


MARKS = [("ds0", 1 * DAY + 12 * 3600, 1), ("ds1", 8 * DAY + 12 * 3600, 1), ("ds0", 0, 0), ("ds3", 5, 0)]


def folders_read(frame):
    """How many folders the scans of a frame of files read, from their metrics."""
    spark = frame.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame.collect()
        leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i).metrics() for i in range(leaves.size())]
        return sum(m.get("numPartitions").get().value() for m in scans if m.contains("numPartitions"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("pairs", [100_000, 0])
def test_scan_by_day_reads_the_days_of_each_mark(spark, tmp_path, monkeypatch, pairs):
    monkeypatch.setattr(source, "PAIRS", pairs)
    monkeypatch.setattr(source, "NAMES", pairs)
    null = "'n' || id AS id, query, top_score, created_at, search_type, is_duplicate, CAST(null AS string) AS dataset_id"
    rows = search_log(spark)
    rows = rows.unionByName(rows.filter("dataset_id = 'ds2'").selectExpr(*null.split(", ")))
    log = source.land_by_day(rows, f"{tmp_path}/log")
    marks = source.marks(spark.createDataFrame(MARKS, "dataset_id string, last_collapsed bigint, created_at bigint"))
    found = source.since_marks_by_day(log, marks)
    assert found.columns == rows.columns
    assert rows_of(found) == rows_of(source.since_marks(rows, marks))
    if pairs:
        assert "dynamicpruning" in found._jdf.queryExecution().toString()
        # ds0 from day 1 and ds1 on day 8, day 9 of the three with a name, all days of the two without a mark
        assert folders_read(source.since_marks_by_day(log, marks)) == 8 + 1 + 3 + 20
    none = spark.createDataFrame([], "dataset_id string, last_collapsed bigint, created_at bigint")
    assert rows_of(source.since_marks_by_day(log, source.marks(none))) == rows_of(source.since_marks(rows, source.marks(none)))


def test_counters_are_observed_in_the_pass_that_writes(spark, tmp_path):
    from logloom.plans.ingest import ingest

    payloads = [
        '{"source_type":"file","message":"a"}', '[{"facility":"x","message":"b"},{"message":"c"}]', "[]",
        '{"source_type":"windows_event_log","event_id":4624,"level":1}', '{"source_type":"windows_event_log","event_id":1102,"level":1}',
        '{"source_type":"windows_event_log","event_id":[1],"level":1}',
    ]
    for n in range(2):
        spark.createDataFrame([(p,) for p in payloads], "raw string").write.text(f"{tmp_path}/in/{n}")
    lines = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 3).text(f"{tmp_path}/in").withColumnRenamed("value", "raw")
    read = spark.sparkContext.accumulator(0)

    def tally(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    out = [f"{tmp_path}/{name}" for name in ("queue", "metrics", "c")]
    stream.enqueue_counted(lines.mapInPandas(tally, "raw string"), *out, continuous=False).awaitTermination()
    # each payload was read, and so mapped, just once
    assert read.value == 2 * len(payloads)
    counted = spark.read.parquet(out[1]).groupBy("metric", "label").agg(F.sum("value").alias("value"))
    plain = stream.batch_metrics(ingest(spark.read.option("recursiveFileLookup", "true").text(f"{tmp_path}/in").withColumnRenamed("value", "raw")))
    assert rows_of(counted) == rows_of(plain) and counted.count() >= 6
    assert spark.read.parquet(out[0]).count() == counted.filter("metric = 'logs_received'").agg(F.sum("value")).first()[0]


def test_labels_not_known_are_counted_as_other():
    assert stream.counter_rows({"mappings": 5, "mappings:Authentication": 3}) == [("mappings", "Authentication", 3), ("mappings", "other", 2)]
    assert stream.counter_rows({}) == []
