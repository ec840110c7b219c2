"""Dashboards on mapped events: volume alerts, counts over time, analyst overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.spread import latest


def volume(events: DataFrame, time: str, key: str, width: str = "5 minutes", late: str | None = None) -> DataFrame:
    """Events per class and time window; ``late`` sets a watermark for streams."""
    source = events.withWatermark(time, late) if late else events
    return source.groupBy(F.window(time, width).alias("w"), F.col(key).alias("class_name")).agg(
        F.count(F.lit(1)).alias("events")
    ).select(F.col("w.start").alias("window_start"), "class_name", "events")


def volume_alerts(
    events: DataFrame, time: str, key: str, threshold: int, width: str = "5 minutes", late: str | None = None
) -> DataFrame:
    """Windows in which a class appears more than ``threshold`` times."""
    return volume(events, time, key, width, late).filter(F.col("events") > threshold)


def over_time(events: DataFrame, time: str, unit: str, *keys: str | Column) -> DataFrame:
    return events.groupBy(F.date_trunc(unit, time).alias("period"), *keys).agg(
        F.count(F.lit(1)).alias("events")
    )


def with_overrides(classified: DataFrame, overrides: DataFrame) -> DataFrame:
    """Classifications with the analyst's latest override in place of the found class."""
    last = latest(
        overrides.select("log_id", "override_class", "decided_at"), ["log_id"], ["decided_at", "override_class"]
    )
    joined = classified.join(last.select("log_id", "override_class"), ["log_id"], "left")
    return joined.withColumn("overridden", F.col("override_class").isNotNull()).withColumn(
        "final_class", F.coalesce("override_class", F.col("class_chunk").cast("string"))
    )
