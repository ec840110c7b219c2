"""Counters, the duration histogram and the backlog gauge as grouped frames.

Every counter is a grouped count, combined on the map side before its shuffle,
so one dominant source or class costs no more than the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default bucket bounds of a duration histogram, in seconds
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def per_source(processed: DataFrame, name: str = "logs") -> DataFrame:
    """Logs per source; mapped Windows records carry no source and count as unknown."""
    return processed.groupBy(F.coalesce("source", F.lit("unknown")).alias("source_type")).agg(
        F.count(F.lit(1)).alias(name)
    )


def per_error(errors: DataFrame, error_type: str = "error_type") -> DataFrame:
    return (
        errors.filter(F.col(error_type).isNotNull())
        .groupBy(F.col(error_type).alias("error_type"))
        .agg(F.count(F.lit(1)).alias("errors"))
    )


def mappings(processed: DataFrame) -> DataFrame:
    """Mappings per class and status; failed mappings are counted by :func:`mapping_errors`."""
    return (
        processed.filter(F.col("map_status") == "success")
        # leaves are selected before grouping, so no other part of the record is built
        .select(F.col("mapped_class_name").alias("event_class"), F.col("map_status").alias("status"))
        .groupBy("event_class", "status")
        .agg(F.count(F.lit(1)).alias("mappings"))
    )


def mapping_errors(processed: DataFrame) -> DataFrame:
    return per_error(processed, "map_error_type")


def high_criticality(processed: DataFrame) -> DataFrame:
    return processed.filter(F.col("criticality") == "high")


def high_criticality_counts(processed: DataFrame) -> DataFrame:
    return high_criticality(processed).groupBy("event_id").agg(F.count(F.lit(1)).alias("events"))


def histogram(
    durations: DataFrame,
    operation: str,
    seconds: str,
    buckets: Sequence[float] = BUCKETS,
) -> DataFrame:
    """Cumulative bucket counts, sum and count per operation in one pass.

    Rows (operation, le, observations, total_seconds, total_count); the last
    bucket is +Inf.
    """
    value = F.col(seconds)
    wide = durations.groupBy(F.col(operation).alias("operation")).agg(
        *[F.count(F.when(value <= le, 1)).alias(f"b{i}") for i, le in enumerate(buckets)],
        F.sum(value).alias("total_seconds"),
        F.count(value).alias("total_count"),
    )
    cells = [
        F.struct(F.lit(float(le)).alias("le"), F.col(f"b{i}").alias("observations"))
        for i, le in enumerate(buckets)
    ] + [F.struct(F.lit(float("inf")).alias("le"), F.col("total_count").alias("observations"))]
    return wide.select(
        "operation", F.inline(F.array(*cells)), "total_seconds", "total_count"
    )


def backlog(queued: DataFrame, consumed: DataFrame) -> DataFrame:
    """Records put in minus records taken out."""
    signed = queued.select(F.lit(1).cast("bigint").alias("n")).unionAll(
        consumed.select(F.lit(-1).cast("bigint").alias("n"))
    )
    return signed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("queue_size"))
