"""Collection-stage transforms and filters: normalise, Windows XML, pass filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import variant as V
from logloom.functions.text import iso_millis
from logloom.operators.lookups import CHANNELS, FORWARDED_EVENTS

_XML = (
    "System STRUCT<"
    "EventID: STRUCT<_VALUE: STRING>, Provider: STRUCT<_VALUE: STRING, _Name: STRING>, Level: STRING,"
    "Task: STRING, Opcode: STRING, Keywords: STRING, Channel: STRING, Computer: STRING,"
    "Execution: STRUCT<_ProcessID: STRING, _ThreadID: STRING, ProcessID: STRING, ThreadID: STRING>,"
    "Correlation: STRUCT<_ActivityID: STRING, _RelatedActivityID: STRING, ActivityID: STRING, RelatedActivityID: STRING>,"
    "TimeCreated: STRUCT<_SystemTime: STRING, SystemTime: STRING>>,"
    "EventData STRUCT<Data: ARRAY<STRUCT<_VALUE: STRING, _Name: STRING>>>"
)


def normalize(events: DataFrame, source_type: str | None = None) -> DataFrame:
    """Replace a record by the JSON object in its message, stamp time and source, rename ``eventID``.

    Takes and returns ``doc`` (VARIANT). A record whose timestamp cannot be read
    passes through as it came, as a failed remap does in the collecting agent.
    """
    message = V.get("doc", "$.message")
    inner = F.try_parse_json(message)
    record = F.when(F.ltrim(message).startswith("{") & inner.isNotNull(), inner).otherwise(F.col("doc"))
    source = F.lit(source_type) if source_type else V.get("doc", "$.source_type")
    staged = events.withColumn("_rec", record).withColumn("_src", source)
    staged = (
        staged.withColumn("_ts", F.try_to_timestamp(V.get("_rec", "$.timestamp")))
        .withColumn("_eid", V.field("_rec", "$.eventID"))
        .withColumn("_fields", F.try_variant_get("_rec", "$", "map<string,variant>"))
    )
    stamped = F.create_map(
        F.lit("timestamp"), iso_millis("_ts").cast("variant"),
        F.lit("source_type"), F.col("_src").cast("variant"),
        F.lit("normalized"), F.lit(True).cast("variant"),
    )
    renamed = F.when(
        F.col("_eid").isNotNull(), F.create_map(F.lit("event_id"), F.col("_eid"))
    ).otherwise(F.expr("cast(map() as map<string,variant>)"))
    kept = F.map_filter(
        "_fields",
        lambda k, _: ~k.isin("timestamp", "source_type", "normalized", "eventID")
        & ((k != "event_id") | F.col("_eid").isNull()),
    )
    doc = F.when(
        F.col("_ts").isNotNull(), F.to_variant_object(F.map_concat(kept, stamped, renamed))
    ).otherwise(F.col("doc"))
    return staged.withColumn("doc", doc).select(*events.columns)


def complete(events: DataFrame) -> DataFrame:
    """Keep records that have a timestamp and a message that is not null."""
    return events.filter(
        ~V.is_missing("doc", "$.timestamp")
        & ~V.is_missing("doc", "$.message")
        & ~V.is_null("doc", "$.message")
    )


def windows_columns(events: DataFrame, xml: str = "message") -> DataFrame:
    """Columns of Windows event XML. Malformed XML gives a row with ``parsed`` false.

    Process, thread and activity ids and the time are read as attributes or as elements.
    """
    parsed = events.withColumn("_x", F.from_xml(F.col(xml), _XML))
    system = "_x.System"

    def number(path: str) -> Column:
        return F.col(path).try_cast("int")

    def either(parent: str, name: str) -> Column:
        return F.coalesce(F.col(f"{system}.{parent}._{name}"), F.col(f"{system}.{parent}.{name}"))

    return parsed.select(
        *events.columns,
        F.col(system).isNotNull().alias("parsed"),
        number(f"{system}.EventID._VALUE").alias("event_id"),
        F.coalesce(F.col(f"{system}.Provider._Name"), F.col(f"{system}.Provider._VALUE")).alias("provider"),
        number(f"{system}.Level").alias("level"),
        number(f"{system}.Task").alias("task"),
        number(f"{system}.Opcode").alias("opcode"),
        F.col(f"{system}.Keywords").alias("keywords"),
        F.col(f"{system}.Channel").alias("channel"),
        F.col(f"{system}.Computer").alias("computer"),
        F.struct(
            either("Execution", "ProcessID").try_cast("int").alias("process_id"),
            either("Execution", "ThreadID").try_cast("int").alias("thread_id"),
        ).alias("execution"),
        F.struct(
            either("Correlation", "ActivityID").alias("activity_id"),
            either("Correlation", "RelatedActivityID").alias("related_activity_id"),
        ).alias("correlation"),
        iso_millis(F.try_to_timestamp(either("TimeCreated", "SystemTime"))).alias("timestamp"),
        F.transform(
            F.col("_x.EventData.Data"),
            lambda d: F.struct(d["_Name"].alias("name"), d["_VALUE"].alias("value")),
        ).alias("event_data"),
    )


def windows_documents(columns: DataFrame) -> DataFrame:
    """Rows of :func:`windows_columns` as ``doc`` records for the dispatcher."""
    named = F.filter(F.coalesce("event_data", F.expr("array()")), lambda d: d["name"].isNotNull())
    names = F.array_distinct(F.transform(named, lambda d: d["name"]))
    # a repeated name keeps its last value
    data = F.map_from_arrays(
        names,
        F.transform(names, lambda n: F.element_at(F.filter(named, lambda d: d["name"] == n), -1)["value"]),
    )
    record = F.struct(
        "timestamp", "event_id", "provider", "level", "task", "opcode", "keywords", "channel",
        "computer", "execution", "correlation",
        F.lit("windows_event_log").alias("source_type"),
        data.alias("event_data"),
    )
    return columns.filter("parsed").select("*", F.to_variant_object(record).alias("doc"))


def from_channels(columns: DataFrame, channels=CHANNELS) -> DataFrame:
    return columns.filter(F.col("channel").isin(*channels))


def critical(columns: DataFrame, event_ids=FORWARDED_EVENTS) -> DataFrame:
    """Events always forwarded. The list is shorter than the table of high-criticality ids."""
    return columns.filter(F.col("event_id").try_cast("int").isin(*event_ids))
