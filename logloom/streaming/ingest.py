"""Continuous ingest: the batch operators on a stream, with counters per batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.operators.agent import complete, normalize
from logloom.operators.dispatch import record_json
from logloom.operators.lookups import EVENT_CLASSES, HIGH_EVENTS, UNKNOWN_CLASS
from logloom.plans.ingest import ingest
from logloom.sinks.tables import queued

# The agent sends after this many events or seconds
BATCH_EVENTS = 100
BATCH_SECONDS = 1


def _trigger(writer, continuous: bool):
    if continuous:
        return writer.trigger(processingTime=f"{BATCH_SECONDS} second")
    return writer.trigger(availableNow=True)


def forward(
    events: DataFrame, out: str, checkpoint: str, source_type: str | None = None, continuous: bool = True
) -> StreamingQuery:
    """Normalise, filter and send records on as gzip JSON files of at most 100 events."""
    ready = complete(normalize(events, source_type)).select(F.to_json("doc").alias("value"))
    writer = (
        ready.writeStream.format("text")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", BATCH_EVENTS)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, continuous).start(out)


def enqueue(
    raw: DataFrame,
    out: str,
    checkpoint: str,
    rules=None,
    now: Column | None = None,
    continuous: bool = True,
) -> StreamingQuery:
    """Process payloads and append the records to the queue table, exactly once."""
    records = queued(record_json(ingest(raw, rules, now)), now)
    writer = (
        records.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, continuous).start(out)


def count_batches(
    raw: DataFrame, out: str, checkpoint: str, now: Column | None = None, continuous: bool = True
) -> StreamingQuery:
    """Counters of every micro-batch as rows (metric, label, value) below ``out/batch_id=N``.

    A batch that is run again writes its own folder anew, so nothing counts twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch_metrics(ingest(batch, now=now)).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, continuous).start()


def enqueue_counted(
    raw: DataFrame,
    out: str,
    counters: str,
    checkpoint: str,
    rules=None,
    now: Column | None = None,
    continuous: bool = True,
) -> StreamingQuery:
    """Append records to the queue and count them in the same pass.

    The counters are observed on the rows while they are written, so the mapping runs once. Records go to
    ``out/batch_id=N`` and counters (metric, label, value) to ``counters/batch_id=N``; a
    batch that is run again writes both anew. The pass has no shuffle, so
    its tasks' counts are added once each, also if executors are lost.
    """
    spark = raw.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"counters-{batch_id}")
        processed = ingest(batch, rules, now).observe(seen, *observed_counts())
        queued(record_json(processed), now).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        rows = spark.createDataFrame(counter_rows(seen.get), "metric string, label string, value bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{counters}/batch_id={batch_id}")

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, continuous).start()


def _known_labels() -> dict[str, tuple[Column, Column, Iterable[str]]]:
    """Each counter's label, when a row counts, and the labels that can occur."""
    source = F.coalesce("source", F.lit("unknown"))
    sources = ("file", "syslog", "unknown")
    classes = sorted({name for _, name, _ in [*EVENT_CLASSES.values(), UNKNOWN_CLASS]})
    return {
        "logs_received": (source, F.lit(True), sources),
        "logs_processed": (source, F.col("route").isNotNull(), sources),
        "mappings": (F.col("mapped_class_name"), F.col("map_status") == "success", classes),
        "mapping_errors": (F.col("map_error_type"), F.col("map_status") == "error", ("TypeError",)),
        "high_criticality": (F.col("event_id").cast("string"), F.col("criticality") == "high", [str(e) for e in HIGH_EVENTS]),
    }


def observed_counts() -> list[Column]:
    """The counters as aggregates over all rows: one per known label, and one per counter over all labels."""
    counts = []
    for metric, (label, when, labels) in _known_labels().items():
        counts.append(F.count_if(when).alias(metric))
        counts += [F.count_if(when & (label == known)).alias(f"{metric}:{known}") for known in labels]
    return counts


def counter_rows(seen: dict) -> list[tuple[str, str, int]]:
    """Rows (metric, label, value) of the counts observed; what no known label holds is counted as ``other``."""
    rows = []
    for metric, (_, _, labels) in _known_labels().items():
        own = [(metric, known, seen.get(f"{metric}:{known}") or 0) for known in labels]
        own.append((metric, "other", (seen.get(metric) or 0) - sum(n for _, _, n in own)))
        rows += [r for r in own if r[2]]
    return rows


def batch_metrics(processed: DataFrame) -> DataFrame:
    """All counters of a frame of processed records in one grouped pass."""
    source = F.coalesce("source", F.lit("unknown"))

    def entry(metric: str, label: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(metric).alias("metric"), label.cast("string").alias("label")))

    entries = F.array_compact(
        F.array(
            entry("logs_received", source, F.lit(True)),
            entry("logs_processed", source, F.col("route").isNotNull()),
            entry("mappings", F.col("mapped_class_name"), F.col("map_status") == "success"),
            entry("mapping_errors", F.col("map_error_type"), F.col("map_status") == "error"),
            entry("high_criticality", F.col("event_id"), F.col("criticality") == "high"),
        )
    )
    return (
        processed.select(F.explode(entries).alias("e"))
        .groupBy("e.metric", "e.label")
        .agg(F.count(F.lit(1)).alias("value"))
    )
