"""Queries that land given tables as files and run the streaming jobs over them to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import variant as V
from logloom.session import scratch_path, shuffle_width
from logloom.sources import logs as source
from logloom.streaming import ingest as stream
from workload.ingest import AGENT_COMPLETE, AGENT_NORMALIZE, DISPATCHED, MAPPED, agent_input, now
from workload.inputs import raw_logs


def _landed(spark, path, name):
    """Raw payloads as text files, read as a stream of two batches."""
    out = scratch_path(spark, name)
    files = 2 * shuffle_width(spark)
    raw_logs(spark, path).select("raw").repartition(files).write.text(f"{out}/raw")
    stream = spark.readStream.option("maxFilesPerTrigger", files // 2).text(f"{out}/raw")
    return out, stream.withColumnRenamed("value", "raw")


def queued_logs(spark, path):
    """Payloads through the stream into the queue table, and the queue consumed as a stream."""
    out, raw = _landed(spark, path, "queue")
    stream.enqueue(raw, f"{out}/queue", f"{out}/c1", now=now(), continuous=False).awaitTermination()
    taken = source.queue(spark, f"{out}/queue")
    query = (
        taken.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/c2")
        .trigger(availableNow=True)
        .start(f"{out}/taken")
    )
    query.awaitTermination()
    record = F.try_parse_json("record")
    rows = source.queue_batch(spark, f"{out}/taken").withColumn("doc", record)
    return rows.groupBy(
        V.get("doc", "$.source").alias("source"),
        V.get("doc", "$.class_name").alias("class_name"),
        V.get("doc", "$.metadata.host").alias("host"),
        V.get("doc", "$.queued_at").alias("queued_at"),
    ).agg(F.count(F.lit(1)).alias("records"))


QUEUED = f"""
SELECT source, class_name, host, '2024-06-01T00:00:00.000000' AS queued_at, count(*) AS records FROM (
  SELECT d.source, CASE WHEN d.route = 'windows' THEN CASE WHEN m.faulty THEN 'Unknown' ELSE m.class_name END END AS class_name, d.host
  FROM ({DISPATCHED}) d LEFT JOIN ({MAPPED}) m ON m.n = d.n) x GROUP BY ALL"""


def streamed_counters(spark, path):
    """Counters of every micro-batch, added up."""
    out, raw = _landed(spark, path, "counters")
    stream.count_batches(raw, f"{out}/metrics", f"{out}/c", now(), continuous=False).awaitTermination()
    rows = spark.read.parquet(f"{out}/metrics")
    return rows.groupBy("metric", "label").agg(F.sum("value").alias("value"))


COUNTERS = f"""
SELECT 'logs_received' AS metric, coalesce(source, 'unknown') AS label, CAST(count(*) AS BIGINT) AS value FROM ({DISPATCHED}) d GROUP BY 2
UNION ALL SELECT 'logs_processed', coalesce(source, 'unknown'), count(*) FROM ({DISPATCHED}) d GROUP BY 2
UNION ALL SELECT 'mappings', class_name, count(*) FROM ({MAPPED}) m WHERE NOT faulty GROUP BY 2
UNION ALL SELECT 'mapping_errors', 'TypeError', count(*) FROM ({MAPPED}) m WHERE faulty
UNION ALL SELECT 'high_criticality', CAST(win_id AS VARCHAR), count(*) FROM ({MAPPED}) m WHERE criticality = 'high' GROUP BY 2"""


def observed_counters(spark, path):
    """Counters observed while the queue is written, beside the number of records in it."""
    out, raw = _landed(spark, path, "observed")
    stream.enqueue_counted(raw, f"{out}/queue", f"{out}/metrics", f"{out}/c", now=now(), continuous=False).awaitTermination()
    counted = spark.read.parquet(f"{out}/metrics").groupBy("metric", "label").agg(F.sum("value").alias("value"))
    records = spark.read.parquet(f"{out}/queue").agg(F.count(F.lit(1)).alias("value"))
    return counted.unionByName(records.select(F.lit("queued").alias("metric"), F.lit("all").alias("label"), "value"))


OBSERVED = f"{COUNTERS} UNION ALL SELECT 'queued', 'all', count(*) FROM ({DISPATCHED}) d"


def forwarded_logs(spark, path):
    """Agent records normalised, filtered and sent on as gzip files of at most 100 events."""
    out = scratch_path(spark, "forward")
    agent_input(spark, path).select(F.to_json("doc").alias("value")).write.text(f"{out}/agent")
    events = spark.readStream.text(f"{out}/agent").select(F.try_parse_json("value").alias("doc"))
    stream.forward(events, f"{out}/sent", f"{out}/c", "windows_event_log", continuous=False).awaitTermination()
    sent = spark.read.text(f"{out}/sent").withColumn("file", F.col("_metadata.file_path"))
    sizes = sent.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") <= 100
    doc = F.try_parse_json("value")
    kept = [V.get("doc", f"$.{c}").alias(c) for c in ("timestamp", "source_type", "message", "computer")]
    return sent.join(sizes, "file").withColumn("doc", doc).groupBy(*kept, small.alias("small_file")).agg(
        F.count(F.lit(1)).alias("events")
    )


FORWARDED = f"""
SELECT timestamp, source_type, message, computer, true AS small_file, count(*) AS events FROM ({AGENT_NORMALIZE}) a
WHERE n IN (SELECT n FROM ({AGENT_COMPLETE}) c) GROUP BY ALL"""


ENTRIES = {
    "queued_logs": (queued_logs, QUEUED),
    "streamed_counters": (streamed_counters, COUNTERS),
    "observed_counters": (observed_counters, OBSERVED),
    "forwarded_logs": (forwarded_logs, FORWARDED),
}
