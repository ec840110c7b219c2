"""Raw logs: files, syslog lines, Windows event XML, ingest payloads, the queue."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import variant as V
from logloom.functions.text import iso_millis

# Agent limits
IGNORE_OLDER_SECS = 600
SYSLOG_MAX_BYTES = 65_536

# Syslog facility and severity keywords by code (RFC 5424)
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv",
    "ftp", "ntp", "audit", "alert", "clock", "local0", "local1", "local2", "local3", "local4",
    "local5", "local6", "local7",
)
LEVELS = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")


def log_files(
    spark: SparkSession,
    paths: str | list[str],
    ignore_older_secs: int | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Lines of log files as ``doc`` records.

    ``ignore_older_secs`` leaves out files not changed lately, as the agent does
    with ``IGNORE_OLDER_SECS``; a backfill reads all.
    """
    reader = spark.read
    if ignore_older_secs is not None:
        limit = (as_of or datetime.now(timezone.utc).replace(tzinfo=None)) - timedelta(seconds=ignore_older_secs)
        reader = reader.option("modifiedAfter", limit.strftime("%Y-%m-%dT%H:%M:%S")).option(
            "timeZone", "UTC"
        )
    return _file_records(reader.text(paths))


def log_file_stream(
    spark: SparkSession,
    path: str,
    ignore_older_secs: int = IGNORE_OLDER_SECS,
    files_per_trigger: int = 1000,
) -> DataFrame:
    """The same as a stream. ``maxFileAge`` counts back from the newest file, not from now."""
    lines = (
        spark.readStream.option("maxFileAge", f"{ignore_older_secs}s")
        .option("maxFilesPerTrigger", files_per_trigger)
        .text(path)
    )
    return _file_records(lines)


def _file_records(lines: DataFrame) -> DataFrame:
    record = F.struct(
        F.col("value").alias("message"),
        F.struct(F.col("_metadata.file_path").alias("path")).alias("file"),
        iso_millis("_metadata.file_modification_time").alias("timestamp"),
        F.lit("file").alias("source_type"),
    )
    return lines.select(F.to_variant_object(record).alias("doc"))


def _by_code(names: tuple[str, ...], code: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), code + 1)


def syslog_refused(lines: DataFrame, value: str = "value", max_bytes: int = SYSLOG_MAX_BYTES) -> DataFrame:
    """The lines longer than :func:`syslog` accepts, with why."""
    return lines.filter(F.octet_length(value) > max_bytes).select(*lines.columns, F.lit("oversize").alias("error_type"))


def syslog(
    lines: DataFrame, value: str = "value", year: int | None = None, max_bytes: int | None = SYSLOG_MAX_BYTES
) -> DataFrame:
    """Columns facility, severity, host, timestamp, message of syslog lines.

    Lines of more than ``max_bytes`` are refused, see :func:`syslog_refused`; None accepts all. Both the RFC 5424 and the
    RFC 3164 header are read; the latter has no year, so ``year`` supplies it.
    A line without priority keeps facility and severity null.
    """
    text = F.col(value)
    new = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (?:-|(?:\[.*?\])+)\s?(.*)$"
    old = r"^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}) (\S+) (.*)$"
    bare = r"^<(\d{1,3})>(.*)$"
    at = F.lit(year) if year else F.year(F.current_date())

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    accepted = lines if max_bytes is None else lines.filter(~F.coalesce(F.octet_length(text) > max_bytes, F.lit(False)))
    staged = accepted.withColumn(
        "_form",
        F.when(text.rlike(new), 2).when(text.rlike(old), 1).when(text.rlike(bare), 0),
    )
    code = F.when(F.col("_form").isNotNull(), part(bare, 1).try_cast("int"))
    stamp = F.when(F.col("_form") == 2, F.try_to_timestamp(part(new, 2))).when(
        F.col("_form") == 1,
        F.try_to_timestamp(
            F.concat_ws(" ", at.cast("string"), F.regexp_replace(part(old, 2), r" +", " ")),
            F.lit("yyyy MMM d HH:mm:ss"),
        ),
    )
    facility_code = F.when(code <= 191, F.floor(code / 8).cast("int"))
    level_code = F.when(code <= 191, F.pmod(code, F.lit(8)).cast("int"))
    dash = lambda c: F.when(c != "-", c)
    return staged.select(
        *lines.columns,
        facility_code.alias("facility_code"),
        level_code.alias("severity_code"),
        _by_code(FACILITIES, facility_code).alias("facility"),
        _by_code(LEVELS, level_code).alias("severity"),
        F.when(F.col("_form") == 2, dash(part(new, 3)))
        .when(F.col("_form") == 1, part(old, 3))
        .alias("host"),
        iso_millis(stamp).alias("timestamp"),
        F.when(F.col("_form") == 2, part(new, 7))
        .when(F.col("_form") == 1, part(old, 4))
        .when(F.col("_form") == 0, part(bare, 2))
        .otherwise(text)
        .alias("message"),
    )


def syslog_documents(columns: DataFrame) -> DataFrame:
    """Rows of :func:`syslog` as ``doc`` records; absent parts become missing keys."""
    names = ("facility", "severity", "host", "timestamp", "message")
    entries = F.filter(
        F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names]),
        lambda e: e["value"].isNotNull(),
    )
    source = F.create_map(F.lit("source_type"), F.lit("syslog"))
    return columns.withColumn("doc", F.to_variant_object(F.map_concat(F.map_from_entries(entries), source)))


def payloads(raw: DataFrame, value: str = "raw") -> DataFrame:
    """Ingest payloads, an object or an array of objects, as one ``doc`` row per record.

    A payload that is not JSON, or holds anything but objects, is refused whole;
    :func:`refused` counts those.
    """
    return _records(raw, value).filter(F.col("doc").isNotNull())


def refused(raw: DataFrame, value: str = "raw") -> DataFrame:
    return (
        _records(raw, value)
        .filter(F.col("item").isNull())
        .select(*raw.columns, F.lit("processing_error").alias("error_type"))
    )


def _records(raw: DataFrame, value: str) -> DataFrame:
    """Records of each payload; a refused one gives a row without ``item``, an empty one a row
    without ``doc``.

    Filters come after the outer explode: before it, the planner would copy the
    parsing into them and parse every payload twice.
    """
    staged = raw.withColumn("_text", V.unwrap(value)).withColumn("_doc", F.try_parse_json("_text"))
    staged = staged.withColumn("_list", F.try_variant_get("_doc", "$", "array<variant>"))
    nothing = F.lit(None).cast("variant")
    items = (
        F.when(V.starts(F.col("_text"), "{") & F.col("_doc").isNotNull(), F.array("_doc"))
        .when(F.size("_list") == 0, F.array(nothing))
        .when(F.expr(f"forall(_list, e -> {V.sql('e', '$', 'struct<>')} IS NOT NULL)"), F.col("_list"))
    )
    return staged.withColumn("_items", items).select(
        *raw.columns, F.posexplode_outer("_items").alias("item", "doc")
    )


def queue(spark: SparkSession, path: str) -> DataFrame:
    """Queued records in arrival order of files, as a stream."""
    return spark.readStream.schema("record string, queued_at timestamp").parquet(path)


def queue_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("record string, queued_at timestamp").parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same queue on a broker topic; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
        .select(F.col("value").cast("string").alias("record"), F.col("timestamp").alias("queued_at"))
    )
