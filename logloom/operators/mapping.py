"""Windows event to common nested record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import variant as V
from logloom.operators.lookups import RECORD_TYPE, SEVERITIES, class_of, criticality_of

# Parts of a mapped record; an error record fills class_uid, class_name, time, message,
# severity and metadata only
PARTS = (
    "type_uid", "class_uid", "class_name", "activity_id", "activity_name", "time", "message",
    "severity", "status", "category", "actor", "target", "device", "process", "authentication",
    "metadata",
)


def numeric_id(doc: str, path: str, strict: bool = True) -> Column:
    """Integer value of a JSON number; JSON strings count only if not ``strict``."""
    fits = f"{V.sql(doc, path, 'double')} % 1 = 0"
    if strict:
        fits = f"{V.number_sql(doc, path)} AND {fits}"
    return F.expr(f"CASE WHEN {fits} THEN {V.sql(doc, path, 'bigint')} END")


def severity_of(level: str) -> Column:
    names = ", ".join(f"{k}, '{v}'" for k, v in SEVERITIES.items())
    return F.expr(f"coalesce(try_element_at(map({names}), cast({level} AS int)), 'UNKNOWN')")


def keyword_status(doc: str = "doc", path: str = "$.keywords") -> Column:
    """Status of keywords in any JSON shape: text is searched, lists and objects by member."""
    text = V.sql(doc, path)
    members = (
        f"coalesce({V.sql(doc, path, 'array<string>')}, map_keys({V.sql(doc, path, 'map<string,variant>')}))"
    )

    def status(has: str) -> str:
        success, failure = has.format("'Audit Success'"), has.format("'Audit Failure'")
        return f"CASE WHEN {success} THEN 'SUCCESS' WHEN {failure} THEN 'FAILURE' ELSE 'UNKNOWN' END"

    nested = f"{V.sql(doc, path, 'array<variant>')} IS NOT NULL OR {V.sql(doc, path, 'struct<>')} IS NOT NULL"
    return F.expr(
        f"CASE WHEN {nested} THEN {status(f'array_contains({members}, {{}})')} "
        f"ELSE {status(f'contains({text}, {{}})')} END"
    )


def _struct(doc: str, **members) -> str:
    """SQL text of a struct: a key of the event data, a nested struct, or a fixed text in quotes."""
    parts = []
    for name, value in members.items():
        if isinstance(value, dict):
            value = _struct(doc, **value)
        elif not value.startswith(("'", "$")):
            value = V.sql(doc, f"$.event_data.{value}")
        elif value.startswith("$"):
            value = V.sql(doc, value)
        parts.append(f"'{name}', {value}")
    return f"named_struct({', '.join(parts)})"


# The nested parts of a mapped record, and the event fields each member comes from
SUBJECT = {
    "user": {
        "name": "SubjectUserName", "uid": "SubjectUserSid", "domain": "SubjectDomainName",
        "type": "'Windows'", "session_uid": "SubjectLogonId",
    },
    "session": {"uid": "SubjectLogonId"},
}
TARGET = {
    "user": {
        "name": "TargetUserName", "uid": "TargetUserSid", "domain": "TargetDomainName", "type": "'Windows'",
    },
    "process": {"name": "TargetProcessName", "pid": "TargetProcessId"},
    "resource": {"name": "ObjectName", "type": "ObjectType"},
}
DEVICE = {
    "hostname": "$.computer", "uid": "WorkstationName", "ip": "IpAddress", "port": "IpPort",
    "os": {"name": "'Windows'", "type": "'Windows'"},
}
PROCESS = {
    "name": "ProcessName", "pid": "ProcessId", "cmd_line": "CommandLine",
    "parent_process": {"pid": "ParentProcessId", "name": "ParentProcessName"},
}
AUTHENTICATION = {
    "protocol": "AuthenticationPackageName", "logon_type": "LogonType", "process": "LogonProcessName",
    "session": {"uid": "LogonID"},
}
PRODUCT = {
    "name": "'Microsoft Windows'", "vendor_name": "'Microsoft'", "feature": {"name": "'Security Auditing'"},
}


def actor(doc: str = "doc") -> Column:
    return F.expr(_struct(doc, **SUBJECT))


def target(doc: str = "doc") -> Column:
    return F.expr(_struct(doc, **TARGET))


def device(doc: str = "doc") -> Column:
    return F.expr(_struct(doc, **DEVICE))


def process(doc: str = "doc") -> Column:
    return F.expr(_struct(doc, **PROCESS))


def authentication(doc: str = "doc") -> Column:
    return F.expr(_struct(doc, **AUTHENTICATION))


def mapping_fault(doc: str = "doc") -> Column:
    """Struct (type, text) of the first thing that makes a record unmappable, else null."""

    def fault(kind: str, text: str, path: str) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), F.format_string(text, V.type_name(doc, path)).alias("text")
        )

    def nested(path: str) -> Column:
        return V.is_list(doc, path) | V.is_object(doc, path)

    true_scalar = V.is_number(doc, "$.keywords") & (V.get(doc, "$.keywords", "double") != 0)
    no_object = ~V.is_missing(doc, "$.event_data") & ~V.is_object(doc, "$.event_data")
    return (
        F.when(nested("$.event_id"), fault("TypeError", "unhashable type: '%s'", "$.event_id"))
        .when(nested("$.level"), fault("TypeError", "unhashable type: '%s'", "$.level"))
        .when(true_scalar, fault("TypeError", "argument of type '%s' is not iterable", "$.keywords"))
        .when(no_object, fault("AttributeError", "'%s' object has no attribute 'get'", "$.event_data"))
    )


def map_events(
    events: DataFrame,
    doc: str = "doc",
    original: Column | None = None,
    now: Column | None = None,
    strict: bool = True,
    classes: dict | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Add the parts of the mapped record, ``map_status``, ``map_error_type`` and ``criticality``.

    A narrow projection: no join and no shuffle, so it runs on streams unchanged.
    ``classes`` replaces the built-in event table. A record that cannot be mapped
    becomes an error record. ``strict`` keeps text ids and levels unknown. Rows
    outside ``where`` get null parts.

    Every part is a column ``mapped_<part>`` of its own, so the planner drops the
    parts a query does not read; :func:`record` puts them together.
    """
    inside = where if where is not None else F.lit(True)
    staged = (
        events.withColumn("_in", inside)
        .withColumn("_fault", F.when(F.col("_in"), mapping_fault(doc)))
        .withColumn("_ok", F.col("_in") & F.col("_fault").isNull())
        .withColumn("_id", F.when(F.col("_in"), numeric_id(doc, "$.event_id", strict)))
        .withColumn("_level", F.when(F.col("_ok"), numeric_id(doc, "$.level", strict)))
        .withColumn("_class", class_of("_id", classes))
    )
    ok, failed = F.col("_ok"), F.col("_fault").isNotNull()
    error = F.col("_fault.text")
    stamp = F.date_format(
        now if now is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    )
    source = original if original is not None else F.col(doc)

    def leaf(value: Column, on_error: Column | None = None) -> Column:
        chosen = F.when(ok, value)
        return chosen.when(failed, on_error) if on_error is not None else chosen

    parts = {
        "type_uid": leaf(F.lit(RECORD_TYPE)),
        "class_uid": leaf(F.col("_class.uid"), F.lit(0)),
        "class_name": leaf(F.col("_class.name"), F.lit("Unknown")),
        "activity_id": leaf(V.get(doc, "$.event_id", "int")),
        "activity_name": leaf(F.col("_class.activity")),
        "time": leaf(V.get(doc, "$.timestamp"), stamp),
        "message": leaf(V.get(doc, "$.message"), F.concat(F.lit("Failed to map event: "), error)),
        "severity": leaf(severity_of("_level"), F.lit("ERROR")),
        "status": leaf(keyword_status(doc)),
        "category": leaf(V.get(doc, "$.task_category")),
        "actor": leaf(actor(doc)),
        "target": leaf(target(doc)),
        "device": leaf(device(doc)),
        "process": leaf(process(doc)),
        "authentication": leaf(authentication(doc)),
        "metadata": F.struct(
            leaf(V.get(doc, "$.version")).alias("version"),
            leaf(F.expr(_struct(doc, **PRODUCT))).alias("product"),
            F.when(F.col("_in"), source).alias("original_event"),
            error.alias("error"),
        ),
    }
    outcome = [
        F.when(ok, "success").when(failed, "error").alias("map_status"),
        F.col("_fault.type").alias("map_error_type"),
        F.when(F.col("_in"), criticality_of("_id")).alias("criticality"),
    ]
    return staged.select(
        *events.columns, *outcome, *[part.alias(f"mapped_{n}") for n, part in parts.items()]
    )


def record(prefix: str = "mapped_") -> Column:
    """The parts of a mapped record as one struct."""
    return F.struct(*[F.col(f"{prefix}{n}").alias(n) for n in PARTS])
