"""Queries over the search log: scans, prefix collapse, marks, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.spread import latest
from logloom.operators.collapse import neighbour_marks, ordered, superseded
from logloom.plans.collapse import collapse
from logloom.session import scratch_path, shuffle_width
from logloom.sinks import tables as sink
from logloom.sources import searches as source
from logloom.streaming.collapse import collapse_stream, finish
from workload.inputs import MARKS, SEARCHES, view


def searches(spark, path) -> DataFrame:
    return view(spark, path, SEARCHES)


def marks(spark, path) -> DataFrame:
    return view(spark, path, MARKS)


# What a first run scans
FIRST = f"SELECT * FROM ({SEARCHES}) s WHERE is_duplicate = 0 AND search_type <> 'rag'"


def ordered_sql(rows: str) -> str:
    return f"""SELECT *, lower(regexp_replace(query, '^\\s+|\\s+$', '', 'g')) AS q,
  row_number() OVER (PARTITION BY dataset_id ORDER BY created_at, strlen(query), id) AS ordinal FROM ({rows}) r"""


def later_sql(rows: str) -> str:
    return f"""
WITH o AS ({ordered_sql(rows)})
SELECT dataset_id, id FROM o a WHERE EXISTS (SELECT 1 FROM o b WHERE b.dataset_id = a.dataset_id AND b.ordinal > a.ordinal
  AND b.created_at <= a.created_at + 10 AND starts_with(b.q, a.q))"""


def neighbours_sql(rows: str) -> str:
    return f"""
WITH o AS ({ordered_sql(rows)}),
kin AS (SELECT a.dataset_id, a.ordinal AS i, b.ordinal AS j, abs(a.created_at - b.created_at) <= 10 AS near,
    length(b.q) > length(a.q) AS longer
  FROM o a JOIN o b ON a.dataset_id = b.dataset_id AND b.ordinal BETWEEN a.ordinal - 10 AND a.ordinal + 10 AND a.ordinal <> b.ordinal
  WHERE starts_with(a.q, b.q) OR starts_with(b.q, a.q)),
state AS (SELECT dataset_id, i, bool_or(near) AS dup, bool_or(near AND longer) AS own FROM kin GROUP BY ALL),
marked AS (SELECT dataset_id, i AS ordinal FROM state WHERE own
  UNION SELECT k.dataset_id, k.j FROM kin k JOIN state s ON s.dataset_id = k.dataset_id AND s.i = k.i WHERE s.dup AND NOT s.own)
SELECT dataset_id, id FROM o JOIN marked USING (dataset_id, ordinal)"""


LATEST_MARKS = f"SELECT dataset_id, arg_max(last_collapsed, created_at) AS last_collapsed FROM ({MARKS}) m GROUP BY 1"
SINCE = f"""
SELECT s.* FROM ({SEARCHES}) s LEFT JOIN ({LATEST_MARKS}) m ON m.dataset_id = s.dataset_id
WHERE search_type <> 'rag' AND coalesce(created_at >= last_collapsed, is_duplicate = 0)"""


def search_datasets(spark, path):
    return source.datasets(searches(spark, path))


def first_scan(spark, path):
    return source.first_scan(searches(spark, path))


def dataset_marks(spark, path):
    return source.marks(marks(spark, path))


def scan_since_marks(spark, path):
    return source.since_marks(searches(spark, path), source.marks(marks(spark, path)))


def scan_by_day(spark, path):
    """The same scan of a log in folders of dataset and day."""
    log = source.land_by_day(searches(spark, path), scratch_path(spark, "search-log"))
    return source.since_marks_by_day(log, source.marks(marks(spark, path)))


def search_order(spark, path):
    return ordered(source.first_scan(searches(spark, path))).select("dataset_id", "id", "ordinal")


def collapse_later(spark, path):
    return superseded(source.first_scan(searches(spark, path)))


def collapse_neighbours(spark, path):
    return neighbour_marks(source.first_scan(searches(spark, path)))


def mark_duplicates(spark, path):
    rows = searches(spark, path)
    return sink.mark_duplicates(rows, superseded(source.first_scan(rows))).select("id", "dataset_id", "is_duplicate")


def duplicate_rows(spark, path):
    rows = searches(spark, path)
    return sink.duplicate_rows(rows, superseded(source.first_scan(rows)))


def latest_versions(spark, path):
    """The search log with duplicates re-inserted: of each id the last version stays."""
    rows = searches(spark, path)
    again = sink.duplicate_rows(rows, superseded(source.first_scan(rows)))
    both = rows.withColumn("version", F.lit(1)).unionByName(again.withColumn("version", F.lit(2)))
    return latest(both, ["dataset_id", "id"], ["version"])


LATEST_VERSIONS = f"""
SELECT s.id, s.query, s.top_score, s.created_at, s.search_type, CASE WHEN d.id IS NULL THEN 0 ELSE 1 END AS is_duplicate, s.dataset_id,
  CASE WHEN d.id IS NULL THEN 1 ELSE 2 END AS version
FROM ({SEARCHES}) s LEFT JOIN ({later_sql(FIRST)}) d ON d.dataset_id = s.dataset_id AND d.id = s.id"""


def high_water_marks(spark, path):
    return sink.high_water(source.first_scan(searches(spark, path)))


HIGH_WATER = f"""
SELECT md5(concat_ws('|', dataset_id, CAST(max(created_at) AS VARCHAR))) AS id, max(created_at) AS last_collapsed, dataset_id,
  max(created_at) AS created_at FROM ({FIRST}) f GROUP BY dataset_id"""


def collapse_incremental(spark, path):
    return collapse(searches(spark, path), marks(spark, path)).duplicates


def collapse_incremental_neighbours(spark, path):
    return collapse(searches(spark, path), marks(spark, path), "neighbours").duplicates


def collapse_streamed(spark, path):
    """The search log landed in four steps of time, collapsed as a stream."""
    out = scratch_path(spark, "collapse")
    rows = source.first_scan(searches(spark, path)).select("dataset_id", "id", "query", "created_at")
    low, high = rows.agg(F.min("created_at"), F.max("created_at")).first()
    width = (high - low) // 4 + 1
    files = shuffle_width(spark)
    for step in range(4):
        part = rows.filter(F.floor((F.col("created_at") - low) / width) == step)
        part.repartition(files).write.mode("append").parquet(f"{out}/searches")
    # the files of one step are one batch
    stream = (
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{out}/searches")
    )
    query = collapse_stream(
        stream, f"{out}/decided", f"{out}/state", f"{out}/checkpoint", silence=None, continuous=False
    )
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    decided = spark.read.parquet(f"{out}/decided").select("dataset_id", "id", "is_duplicate")
    rest = finish(spark, f"{out}/state", last).select("dataset_id", "id", "is_duplicate")
    return decided.unionByName(rest)


STREAMED = f"""
SELECT f.dataset_id, f.id, CASE WHEN d.id IS NULL THEN 0 ELSE 1 END AS is_duplicate
FROM ({FIRST}) f LEFT JOIN ({later_sql(FIRST)}) d ON d.dataset_id = f.dataset_id AND d.id = f.id"""


AS_OF = 1704067200 + 7 * 86_400 + 9_000


def recent_sample(spark, path):
    """Per dataset 100 recent searches by hash order."""
    rows = searches(spark, path)
    return source.vector_sample(rows, F.lit(AS_OF), n=100, seed="s").select("dataset_id", "id")


SAMPLE = f"""
SELECT dataset_id, id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY md5(concat(id, 's')), id) AS r
  FROM ({SEARCHES}) s WHERE created_at >= {AS_OF} - 7 * 86400 AND is_duplicate = 0) x WHERE r <= 100"""


def large_datasets(spark, path):
    """Searches of the languages-as-datasets with at least thirty searches."""
    rows = searches(spark, path).withColumn("dataset_id", F.concat(F.col("dataset_id"), F.lit("-"), F.col("query").substr(1, 2)))
    return source.enough(rows, 30).select("dataset_id", "id")


LARGE = f"""
WITH r AS (SELECT concat(dataset_id, '-', substr(query, 1, 2)) AS dataset_id, id FROM ({SEARCHES}) s)
SELECT dataset_id, id FROM r WHERE dataset_id IN (SELECT dataset_id FROM r GROUP BY 1 HAVING count(*) >= 30)"""


ENTRIES = {
    "search_datasets": (search_datasets, f"SELECT DISTINCT dataset_id FROM ({SEARCHES}) s"),
    "search_first_scan": (first_scan, FIRST),
    "dataset_marks": (dataset_marks, LATEST_MARKS),
    "search_scan_since_marks": (scan_since_marks, SINCE),
    "search_scan_by_day": (scan_by_day, SINCE),
    "search_order": (search_order, f"SELECT dataset_id, id, ordinal FROM ({ordered_sql(FIRST)}) o"),
    "collapse_later": (collapse_later, later_sql(FIRST)),
    "collapse_neighbours": (collapse_neighbours, neighbours_sql(FIRST)),
    "mark_duplicates": (mark_duplicates, f"SELECT id, dataset_id, is_duplicate FROM ({LATEST_VERSIONS}) v"),
    "duplicate_rows": (duplicate_rows, f"SELECT id, query, top_score, created_at, search_type, is_duplicate, dataset_id FROM ({LATEST_VERSIONS}) v WHERE is_duplicate = 1"),
    "latest_versions": (latest_versions, LATEST_VERSIONS),
    "high_water_marks": (high_water_marks, HIGH_WATER),
    "collapse_incremental": (collapse_incremental, later_sql(SINCE)),
    "collapse_incremental_neighbours": (collapse_incremental_neighbours, neighbours_sql(SINCE)),
    "collapse_streamed": (collapse_streamed, STREAMED),
    "recent_sample": (recent_sample, SAMPLE),
    "large_datasets": (large_datasets, LARGE),
}
