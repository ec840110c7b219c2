"""Collapse of search queries as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom.functions.spread import lookup
from logloom.operators.collapse import TIME_WINDOW, superseded
from logloom.session import drop_path, scratch_path

COLUMNS = ["dataset_id", "id", "query", "created_at"]
# Seconds behind the newest search of all datasets after which a silent dataset is decided
SILENCE = 3600


def _slot(state: str, batch_id: int) -> str:
    return f"{state}/slot={batch_id % 2}"


def collapse_stream(
    searches: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    seconds: int = TIME_WINDOW,
    silence: int | None = SILENCE,
    continuous: bool = True,
) -> StreamingQuery:
    """Decide each search once no later one can reach it; write (.., is_duplicate).

    Every batch runs the batch operator on the new rows and the open ones kept
    from before. A search is decided when its dataset has moved more than
    ``seconds`` past it, or the log as a whole more than ``silence`` seconds, as a
    dataset may fall silent; with ``silence`` None such rows wait for
    :func:`finish`. The others are kept in one of two alternating folders below
    ``state``, so a batch that is run again reads what it read before. A search
    that comes later than that is passed on unmarked. The state is never larger
    than the last ``seconds`` of the searches of datasets heard of lately. What a
    batch wrote for itself is removed at its end.
    """
    spark = searches.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*COLUMNS)
        if batch_id > 0:
            kept = spark.read.schema(rows.schema).parquet(_slot(state, batch_id - 1))
            ends = kept.groupBy("dataset_id").agg(F.max("created_at").alias("_end"))
            judged = lookup(rows, ends, ["dataset_id"], ["id"])
            late = judged.filter(F.col("created_at") < F.col("_end") - seconds).select(*COLUMNS)
            timely = judged.filter(
                F.col("_end").isNull() | (F.col("created_at") >= F.col("_end") - seconds)
            ).select(*COLUMNS)
            rows = timely.unionByName(kept)
        else:
            late = rows.filter(F.lit(False))
        own = scratch_path(spark, "collapse-batch")
        rows.write.parquet(own)
        rows = spark.read.schema(rows.schema).parquet(own)
        ends = rows.groupBy("dataset_id").agg(F.max("created_at").alias("_end"))
        closed = F.col("created_at") < F.col("_end") - seconds
        newest = rows.agg(F.max("created_at")).first()[0]
        if silence is not None and newest is not None:
            closed = closed | (F.col("created_at") < F.lit(newest - max(silence, seconds)))
        judged = lookup(rows, ends, ["dataset_id"], ["id"])
        _flagged(judged.filter(closed).select(*COLUMNS), rows, seconds).unionByName(
            late.withColumn("is_duplicate", F.lit(0))
        ).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        judged.filter(~closed).select(*COLUMNS).write.mode("overwrite").parquet(_slot(state, batch_id))
        drop_path(spark, own)

    writer = searches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime="1 second") if continuous else writer.trigger(availableNow=True)
    return writer.start()


def _flagged(wanted: DataFrame, rows: DataFrame, seconds: int) -> DataFrame:
    marks = superseded(rows, seconds).withColumn("_d", F.lit(1))
    return wanted.join(marks, ["dataset_id", "id"], "left").select(
        *COLUMNS, F.coalesce("_d", F.lit(0)).alias("is_duplicate")
    )


def finish(spark: SparkSession, state: str, last_batch: int, seconds: int = TIME_WINDOW) -> DataFrame:
    """The searches still open after the last batch, decided as if none follow."""
    rows = spark.read.parquet(_slot(state, last_batch))
    return _flagged(rows.select(*COLUMNS), rows, seconds)
