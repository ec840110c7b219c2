"""Normalise records by source type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import variant as V
from logloom.operators.mapping import PARTS, map_events
from logloom.operators.mapping import record as mapped_record


def route_of(doc: str = "doc") -> Column:
    """file, syslog, windows or generic.

    A record its own branch could not read (``file`` or ``event_data`` not an
    object, an id that is a list) goes to the generic branch.
    """

    def readable(path: str) -> Column:
        return V.is_missing(doc, path) | V.is_object(doc, path)

    source = V.get(doc, "$.source_type")
    windows = (
        readable("$.event_data")
        & readable("$.execution")
        & ~V.is_list(doc, "$.event_id")
        & ~V.is_object(doc, "$.event_id")
    )
    return (
        F.when((source == "file") & readable("$.file"), "file")
        .when(source == "syslog", "syslog")
        .when((source == "windows_event_log") & windows, "windows")
        .otherwise("generic")
    )


def file_path(doc: str = "doc") -> Column:
    return V.get_or(doc, "$.file.path", "unknown")


def windows_record(doc: str = "doc") -> Column:
    """The flat record handed to the mapper."""
    plain = (
        "timestamp", "event_id", "version", "level", "task", "opcode", "keywords", "channel",
        "computer", "message", "task_category",
    )
    return F.struct(
        *[V.field(doc, f"$.{name}").alias(name) for name in plain],
        V.field(doc, "$.event_data.SubjectUserName").alias("subject"),
        F.struct(
            V.field(doc, "$.execution.process_id").alias("process_id"),
            V.field(doc, "$.event_data.ProcessName").alias("process_name"),
        ).alias("process_information"),
        V.field(doc, "$.event_data").alias("event_data"),
    )


def process_logs(
    events: DataFrame,
    now: Column | None = None,
    strict: bool = True,
    classes: dict | None = None,
) -> DataFrame:
    """One normalised row per record of ``doc``; Windows events also get the mapped parts.

    ``source`` is null on Windows rows, which carry the mapped record instead;
    on all other rows its parts are null. Input columns are carried along, but
    for those named like a column made here.
    """
    made = {
        "route", "timestamp", "source", "file_path", "facility", "severity", "message", "metadata",
        "map_status", "map_error_type", "criticality", "event_id", *[f"mapped_{p}" for p in PARTS],
    }
    events = events.select(*[c for c in events.columns if c not in made])
    stamp = now if now is not None else F.current_timestamp()
    routed = events.withColumn("route", route_of("doc"))
    route = F.col("route")
    windows = route == "windows"
    mapped = map_events(
        routed, "doc", F.to_variant_object(windows_record("doc")), now, strict, classes, windows
    )
    time = F.when(
        route == "generic",
        V.get_or("doc", "$.timestamp", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
    ).otherwise(V.get("doc", "$.timestamp"))
    label = F.when(route == "generic", "unknown").when(~windows, route)
    metadata = F.struct(
        V.get_or("doc", "$.host", "unknown").alias("host"),
        label.alias("source_type"),
        F.col("doc").alias("original"),
    )
    return mapped.select(
        *events.columns,
        "route",
        F.when(~windows, time).alias("timestamp"),
        label.alias("source"),
        F.when(route == "file", file_path("doc")).alias("file_path"),
        F.when(route == "syslog", V.get_or("doc", "$.facility", "unknown")).alias("facility"),
        F.when(route == "syslog", V.get_or("doc", "$.severity", "unknown")).alias("severity"),
        F.when(~windows, V.get_or("doc", "$.message", "")).alias("message"),
        F.when(~windows, metadata).alias("metadata"),
        *[f"mapped_{part}" for part in PARTS],
        "map_status",
        "map_error_type",
        "criticality",
        F.when(windows, V.get("doc", "$.event_id")).alias("event_id"),
    )


def record_json(processed: DataFrame, name: str = "record") -> DataFrame:
    """The normalised record as JSON text with nulls kept, as it goes to the queue."""
    keep = {"ignoreNullFields": "false"}

    def of(*columns: str) -> Column:
        return F.to_json(F.struct(*columns), keep)

    text = (
        F.when(F.col("route") == "windows", F.to_json(mapped_record(), keep))
        .when(F.col("route") == "file", of("timestamp", "source", "file_path", "message", "metadata"))
        .when(
            F.col("route") == "syslog",
            of("timestamp", "source", "facility", "severity", "message", "metadata"),
        )
        .otherwise(of("timestamp", "source", "message", "metadata"))
    )
    return processed.withColumn(name, text)
