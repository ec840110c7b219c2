"""Queries over raw logs: payloads, normalising, mapping, validation, counters."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import variant as V
from logloom.operators import agent, metrics, monitoring
from logloom.operators.dispatch import process_logs
from logloom.operators.mapping import map_events
from logloom.operators.validation import Rule
from logloom.plans.ingest import ingest
from logloom.session import scratch_path
from logloom.sources import logs as source
from workload.inputs import LOG_STATES, LOGS, MAPPED, raw_logs, tables, view

def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


NOW_TEXT = "2024-06-01T00:00:00.000000"

RULES = [
    Rule(1001, "actor.user.name", True, "string"),
    Rule(1001, "severity", True, "string", ("CRITICAL", "HIGH", "MEDIUM", "LOW")),
    Rule(1002, "activity_id", True, "integer"),
    Rule(1002, "process.name", True, "string"),
    Rule(1003, "device.hostname", True, "string"),
    Rule(1003, "message", True, "string"),
    Rule(1004, "time", True, "string"),
    Rule(1004, "category", True, "string"),
]


def processed(spark: SparkSession, path: str) -> DataFrame:
    return ingest(raw_logs(spark, path), now=now())


def windows(spark: SparkSession, path: str) -> DataFrame:
    return processed(spark, path).filter(F.col("route") == "windows")


def class_counts(spark, path):
    """Flagship: raw payloads to counts per class, severity, status and criticality."""
    return (
        windows(spark, path)
        .select(F.col("mapped_class_name").alias("class_name"), F.col("mapped_severity").alias("severity"), F.col("mapped_status").alias("status"), "criticality")
        .groupBy("class_name", "severity", "status", "criticality")
        .agg(F.count(F.lit(1)).alias("events"))
    )


CLASS_COUNTS = f"""
SELECT CASE WHEN faulty THEN 'Unknown' ELSE class_name END AS class_name,
  CASE WHEN faulty THEN 'ERROR' ELSE severity END AS severity,
  CASE WHEN faulty THEN NULL ELSE status END AS status, criticality, count(*) AS events
FROM ({MAPPED}) m GROUP BY ALL
"""


def payload_records(spark, path):
    return source.payloads(raw_logs(spark, path)).select(
        "n", "item", V.get("doc", "$.source_type").alias("source_type"), V.get("doc", "$.message").alias("message")
    )


PAYLOAD_RECORDS = f"SELECT n, CAST(0 AS INTEGER) AS item, source_type, text AS message FROM ({LOG_STATES}) s WHERE NOT refused"


def refused_payloads(spark, path):
    return metrics.per_error(source.refused(raw_logs(spark, path)))


REFUSED = f"SELECT 'processing_error' AS error_type, count(*) AS errors FROM ({LOG_STATES}) s WHERE refused HAVING count(*) > 0"


def agent_input(spark, path):
    """Agent records: some carry a JSON object as message, some a time that cannot be read."""
    logs = view(spark, path, LOGS)
    n = F.col("n")
    inner = F.to_json(
        F.struct(F.col("ts").cast("string").alias("timestamp"), F.col("win_id").alias("eventID"), F.col("message"))
    )
    record = F.struct(
        F.when(n % 3 == 0, inner).when(n % 41 != 2, F.col("message")).alias("message"),
        F.when(n % 43 == 1, "yesterday").when(n % 47 != 4, F.col("ts").cast("string")).alias("timestamp"),
        F.when(n % 2 == 0, F.col("win_id")).alias("eventID"),
        F.when(n % 4 == 0, F.lit(1)).alias("event_id"),
        F.col("computer"),
    )
    return logs.select("n", F.try_parse_json(F.to_json(record)).alias("doc"))


def agent_normalize(spark, path):
    return agent.normalize(agent_input(spark, path), "windows_event_log").select(
        "n",
        *[V.get("doc", f"$.{c}").alias(c) for c in ("timestamp", "source_type", "normalized", "event_id", "eventID", "message", "computer")],
    )


AGENT_STATES = f"""
SELECT n, win_id, message, computer, n % 3 = 0 AS inner_object,
  (n % 3 = 0 OR (n % 43 <> 1 AND n % 47 <> 4)) AS readable,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp, ts
FROM ({LOGS}) l
"""
AGENT_NORMALIZE = f"""
SELECT n,
  CASE WHEN readable THEN stamp WHEN n % 43 = 1 THEN 'yesterday' END AS timestamp,
  CASE WHEN readable THEN 'windows_event_log' END AS source_type,
  CASE WHEN readable THEN 'true' END AS normalized,
  CASE WHEN inner_object THEN CAST(win_id AS VARCHAR) WHEN NOT readable THEN (CASE WHEN n % 4 = 0 THEN '1' END)
       WHEN n % 2 = 0 THEN CAST(win_id AS VARCHAR) WHEN n % 4 = 0 THEN '1' END AS event_id,
  CASE WHEN NOT readable AND n % 2 = 0 THEN CAST(win_id AS VARCHAR) END AS "eventID",
  CASE WHEN inner_object OR n % 41 <> 2 THEN message END AS message,
  CASE WHEN NOT inner_object THEN computer END AS computer
FROM ({AGENT_STATES}) a
"""


def agent_complete(spark, path):
    ready = agent.complete(agent.normalize(agent_input(spark, path), "windows_event_log"))
    return ready.select("n")


AGENT_COMPLETE = f"""
SELECT n FROM ({AGENT_STATES}) a
WHERE (readable OR n % 43 = 1) AND (inner_object OR n % 41 <> 2)
"""


def syslog_refused_lines(spark, path):
    """Messages as lines, of which those of more than 18 bytes are refused."""
    lines = view(spark, path, LOGS).select("n", F.col("message").alias("value"))
    return source.syslog_refused(lines, max_bytes=18)


SYSLOG_REFUSED = f"SELECT n, message AS value, 'oversize' AS error_type FROM ({LOGS}) l WHERE strlen(message) > 18"


def syslog_lines(spark, path):
    logs = view(spark, path, LOGS)
    n = F.col("n")
    head = F.concat(F.lit("<"), (n % 192).cast("string"), F.lit(">"))
    line = (
        F.when(n % 4 == 0, F.concat(head, F.lit("1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(" "), F.col("computer"), F.lit(" app 77 ID1 - "), F.col("message")))
        .when(n % 4 == 1, F.concat(head, F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" "), F.col("computer"), F.lit(" "), F.col("message")))
        .when(n % 4 == 2, F.concat(head, F.col("message")))
        .when(n % 100 == 3, F.concat(F.col("message"), F.repeat(F.lit("x"), 65_536)))
        .otherwise(F.col("message"))
    )
    return source.syslog(logs.select("n", line.alias("value")), year=2024).drop("value")


SYSLOG_LINES = f"""
SELECT n, CASE WHEN n % 4 <> 3 THEN CAST(floor((n % 192) / 8) AS INTEGER) END AS facility_code,
  CASE WHEN n % 4 <> 3 THEN CAST((n % 192) % 8 AS INTEGER) END AS severity_code,
  CASE WHEN n % 4 <> 3 THEN list_extract(['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp','ntp','audit','alert','clock','local0','local1','local2','local3','local4','local5','local6','local7'], CAST(floor((n % 192) / 8) AS INTEGER) + 1) END AS facility,
  CASE WHEN n % 4 <> 3 THEN list_extract(['emerg','alert','crit','err','warning','notice','info','debug'], CAST((n % 192) % 8 AS INTEGER) + 1) END AS severity,
  CASE WHEN n % 4 IN (0, 1) THEN computer END AS host,
  CASE WHEN n % 4 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'
       WHEN n % 4 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS timestamp,
  message
FROM ({LOGS}) l WHERE NOT (n % 100 = 3 AND n % 4 = 3)
"""


def xml_input(spark, path):
    logs = view(spark, path, LOGS)
    n = F.col("n")

    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    channel = F.element_at(
        F.array(*[F.lit(c) for c in ("Security", "System", "Application", "Setup", "DNS Server")]),
        (n % 5 + 1).cast("int"),
    )
    execution = F.when(
        n % 2 == 0,
        F.concat(F.lit('<Execution ProcessID="'), (n % 1000).cast("string"), F.lit('" ThreadID="8"/>')),
    ).otherwise(tag("Execution", F.concat(tag("ProcessID", (n % 1000).cast("string")), tag("ThreadID", F.lit("8")))))
    good = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Auditing"/>'),
        tag("EventID", F.when(n % 13 == 0, F.lit("abc")).otherwise(F.col("win_id").cast("string"))),
        F.when(F.col("level").isNotNull(), tag("Level", F.col("level").cast("string"))).otherwise(F.lit("")),
        tag("Task", (n % 7).cast("string")),
        tag("Keywords", F.coalesce("keywords", F.lit("none"))),
        F.lit('<TimeCreated SystemTime="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"/>'),
        execution,
        tag("Channel", channel),
        tag("Computer", F.col("computer")),
        F.lit("</System><EventData>"),
        F.lit('<Data Name="SubjectUserName">u'), F.col("user_id").cast("string"), F.lit("</Data>"),
        F.lit('<Data Name="IpAddress">10.0.0.1</Data></EventData></Event>'),
    )
    return logs.select("n", F.when(n % 59 == 0, F.concat(F.lit("<Event><System>"), F.col("message"))).otherwise(good).alias("message"))


def windows_xml(spark, path):
    rows = agent.windows_columns(xml_input(spark, path))
    return rows.select(
        "n", "parsed", "event_id", "provider", "level", "task", "opcode", "keywords", "channel", "computer", "timestamp",
        F.col("execution.process_id").alias("process_id"),
        F.col("execution.thread_id").alias("thread_id"),
        F.element_at(F.filter("event_data", lambda d: d["name"] == "SubjectUserName"), 1)["value"].alias("subject"),
    )


WINDOWS_XML = f"""
SELECT n, n % 59 <> 0 AS parsed,
  CASE WHEN n % 59 <> 0 AND n % 13 <> 0 THEN CAST(win_id AS INTEGER) END AS event_id,
  CASE WHEN n % 59 <> 0 THEN 'Auditing' END AS provider,
  CASE WHEN n % 59 <> 0 THEN CAST(level AS INTEGER) END AS level,
  CASE WHEN n % 59 <> 0 THEN CAST(n % 7 AS INTEGER) END AS task,
  CAST(NULL AS INTEGER) AS opcode,
  CASE WHEN n % 59 <> 0 THEN coalesce(keywords, 'none') END AS keywords,
  CASE WHEN n % 59 <> 0 THEN list_extract(['Security','System','Application','Setup','DNS Server'], CAST(n % 5 + 1 AS INTEGER)) END AS channel,
  CASE WHEN n % 59 <> 0 THEN computer END AS computer,
  CASE WHEN n % 59 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS timestamp,
  CASE WHEN n % 59 <> 0 THEN CAST(n % 1000 AS INTEGER) END AS process_id,
  CASE WHEN n % 59 <> 0 THEN CAST(8 AS INTEGER) END AS thread_id,
  CASE WHEN n % 59 <> 0 THEN concat('u', CAST(user_id AS VARCHAR)) END AS subject
FROM ({LOGS}) l
"""


def windows_channels(spark, path):
    return (
        agent.from_channels(agent.windows_columns(xml_input(spark, path)))
        .groupBy("channel")
        .agg(F.count(F.lit(1)).alias("events"))
    )


WINDOWS_CHANNELS = f"SELECT channel, count(*) AS events FROM ({WINDOWS_XML}) x WHERE channel IN ('Application','DNS Server','Directory Service','File Replication Service','Security','System') GROUP BY channel"


def critical_events(spark, path):
    return agent.critical(agent.windows_columns(xml_input(spark, path))).select("n", "event_id", "computer")


CRITICAL_EVENTS = f"SELECT n, event_id, computer FROM ({WINDOWS_XML}) x WHERE event_id IN (1102,4618,4649,4719,4765,4766,4794,4897,4964)"


def xml_to_mapped(spark, path):
    """Windows XML through the dispatcher: columns, documents, mapped records."""
    docs = agent.windows_documents(agent.windows_columns(xml_input(spark, path))).select("n", "doc")
    return process_logs(docs, now()).select(
        "n", "route", F.col("mapped_class_name").alias("class_name"), F.col("mapped_severity").alias("severity"), F.col("mapped_status").alias("status"), F.col("mapped_time").alias("time"),
        F.col("mapped_actor.user.name").alias("actor"), F.col("mapped_device.ip").alias("ip"), "criticality",
    )


XML_TO_MAPPED = f"""
SELECT x.n, 'windows' AS route,
  CASE WHEN event_id IN (4624,4625,4634) THEN 'Authentication' WHEN event_id IN (4688,4689) THEN 'Process Activity'
       WHEN event_id IN (4656,4663) THEN 'Object Access' WHEN event_id IN (4719,4739) THEN 'Policy Change' ELSE 'Unknown' END AS class_name,
  CASE level WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'LOW' WHEN 5 THEN 'INFO' ELSE 'UNKNOWN' END AS severity,
  CASE WHEN keywords LIKE '%Audit Success%' THEN 'SUCCESS' WHEN keywords LIKE '%Audit Failure%' THEN 'FAILURE' ELSE 'UNKNOWN' END AS status,
  timestamp AS time, subject AS actor, '10.0.0.1' AS ip,
  CASE WHEN event_id IN (517,550,1102,4618,4649,4719,4765,4766,4794,4897,4964) THEN 'high'
       WHEN event_id IN (4621,4675,4692,4693) THEN 'medium' ELSE 'low' END AS criticality
FROM ({WINDOWS_XML}) x WHERE parsed
"""


def dispatched_logs(spark, path):
    return processed(spark, path).select(
        "n", "route", "timestamp", "source", "file_path", "facility", "severity", "message",
        F.col("metadata.host").alias("host"), F.col("metadata.source_type").alias("source_type"),
    )


DISPATCHED = f"""
SELECT n, route,
  CASE WHEN route = 'windows' THEN NULL WHEN route = 'generic' THEN coalesce(stamp, '{NOW_TEXT}') ELSE stamp END AS timestamp,
  CASE route WHEN 'generic' THEN 'unknown' WHEN 'windows' THEN NULL ELSE route END AS source,
  CASE WHEN route <> 'file' THEN NULL WHEN n % 12 = 0 THEN concat('/var/log/', event_type, '.log') ELSE 'unknown' END AS file_path,
  CASE WHEN route <> 'syslog' THEN NULL WHEN n % 8 = 1 THEN 'auth' ELSE 'unknown' END AS facility,
  CASE WHEN route <> 'syslog' THEN NULL WHEN n % 8 = 1 THEN 'err' WHEN n % 8 = 5 THEN NULL ELSE 'unknown' END AS severity,
  CASE WHEN route = 'windows' THEN NULL ELSE coalesce(text, '') END AS message,
  CASE WHEN route = 'windows' THEN NULL ELSE host END AS host,
  CASE route WHEN 'generic' THEN 'unknown' WHEN 'windows' THEN NULL ELSE route END AS source_type
FROM ({LOG_STATES}) s WHERE NOT refused
"""


def one_source(route: str, *columns: str):
    def run(spark, path):
        return dispatched_logs(spark, path).filter(F.col("route") == route).select("n", *columns)

    return run, f"SELECT n, {', '.join(columns)} FROM ({DISPATCHED}) d WHERE route = '{route}'"


def windows_records(spark, path):
    """The flat record handed to the mapper, kept as the original event."""
    event = "mapped_metadata.original_event"
    return windows(spark, path).select(
        "n",
        *[V.get(event, f"$.{c}").alias(c) for c in ("timestamp", "event_id", "level", "keywords", "computer", "message", "subject")],
        V.get(event, "$.process_information.process_id").alias("process_id"),
        V.get(event, "$.process_information.process_name").alias("process_name"),
    )


WINDOWS_RECORDS = f"""
SELECT n, stamp AS timestamp, CAST(win_id AS VARCHAR) AS event_id, CAST(level AS VARCHAR) AS level,
  CASE WHEN faulty THEN '5' ELSE keywords END AS keywords, computer, text AS message,
  CASE WHEN has_data THEN concat('u', CAST(user_id AS VARCHAR)) END AS subject,
  CAST(n % 1000 AS VARCHAR) AS process_id,
  CASE WHEN has_data AND n % 3 = 0 THEN event_type END AS process_name
FROM ({LOG_STATES}) s WHERE NOT refused AND route = 'windows'
"""


def mapped_events(spark, path):
    good = windows(spark, path).filter(F.col("map_status") == "success")
    return good.select(
        "n", F.col("mapped_type_uid").alias("type_uid"), F.col("mapped_class_uid").alias("class_uid"), F.col("mapped_class_name").alias("class_name"), F.col("mapped_activity_id").alias("activity_id"), F.col("mapped_activity_name").alias("activity_name"),
        F.col("mapped_time").alias("time"), F.col("mapped_message").alias("message"), F.col("mapped_severity").alias("severity"), F.col("mapped_status").alias("status"), F.col("mapped_category").alias("category"),
        F.col("mapped_metadata.version").alias("version"),
        F.col("mapped_metadata.product.vendor_name").alias("vendor"),
    )


MAPPED_EVENTS = f"""
SELECT n, CAST(400001 AS INTEGER) AS type_uid, CAST(class_uid AS INTEGER) AS class_uid, class_name,
  CAST(win_id AS INTEGER) AS activity_id, activity_name, stamp AS time, text AS message, severity, status,
  CASE WHEN n % 3 = 0 THEN 'Logon' END AS category, '2' AS version, 'Microsoft' AS vendor
FROM ({MAPPED}) m WHERE NOT faulty
"""


def part_of(columns: dict[str, str], sql: dict[str, str]):
    """A query over one nested part of the mapped record."""

    def run(spark, path):
        good = windows(spark, path).filter(F.col("map_status") == "success")
        return good.select("n", *[F.col(f"mapped_{p}").alias(a) for a, p in columns.items()])

    text = ", ".join(f"{e} AS {a}" for a, e in sql.items())
    return run, f"SELECT n, {text} FROM ({MAPPED}) m WHERE NOT faulty"


NULL = "CAST(NULL AS VARCHAR)"
ACTOR = part_of(
    {"name": "actor.user.name", "uid": "actor.user.uid", "type": "actor.user.type", "session": "actor.session.uid"},
    {"name": "CASE WHEN has_data THEN concat('u', CAST(user_id AS VARCHAR)) END", "uid": NULL, "type": "'Windows'", "session": NULL},
)
TARGET = part_of(
    {"name": "target.user.name", "domain": "target.user.domain", "process": "target.process.name", "resource": "target.resource.name"},
    {"name": "CASE WHEN has_data THEN concat('u', CAST(user_id + 1 AS VARCHAR)) END", "domain": NULL, "process": NULL, "resource": NULL},
)
PROCESS = part_of(
    {"name": "process.name", "pid": "process.pid", "parent": "process.parent_process.name"},
    {"name": "CASE WHEN has_data AND n % 3 = 0 THEN event_type END", "pid": NULL, "parent": NULL},
)
AUTHENTICATION = part_of(
    {"logon_type": "authentication.logon_type", "protocol": "authentication.protocol", "session": "authentication.session.uid"},
    {"logon_type": "CASE WHEN has_data THEN CAST(n % 12 AS VARCHAR) END", "protocol": NULL, "session": NULL},
)
DEVICE = part_of(
    {"hostname": "device.hostname", "uid": "device.uid", "ip": "device.ip", "port": "device.port", "os": "device.os.name"},
    {"hostname": "computer", "uid": "CASE WHEN has_data THEN computer END",
     "ip": "CASE WHEN has_data THEN concat('10.0.0.', CAST(user_id % 250 AS VARCHAR)) END", "port": NULL, "os": "'Windows'"},
)


def error_records(spark, path):
    bad = windows(spark, path).filter(F.col("map_status") == "error")
    return bad.select(
        "n", F.col("mapped_class_uid").alias("class_uid"), F.col("mapped_class_name").alias("class_name"), F.col("mapped_time").alias("time"), F.col("mapped_message").alias("message"), F.col("mapped_severity").alias("severity"),
        F.col("mapped_metadata.error").alias("error"), "map_error_type",
    )


ERROR_RECORDS = f"""
SELECT n, CAST(0 AS INTEGER) AS class_uid, 'Unknown' AS class_name, '{NOW_TEXT}' AS time,
  'Failed to map event: argument of type ''int'' is not iterable' AS message, 'ERROR' AS severity,
  'argument of type ''int'' is not iterable' AS error, 'TypeError' AS map_error_type
FROM ({MAPPED}) m WHERE faulty
"""


def lenient_mapping(spark, path):
    """Mapping that also accepts ids and levels given as text, as the agent casts them."""
    docs = source.payloads(raw_logs(spark, path)).filter(V.get("doc", "$.source_type") == "windows_event_log")
    return (
        map_events(docs, now=now(), strict=False)
        .filter(F.col("map_status") == "success")
        .select(F.col("mapped_class_name").alias("class_name"), F.col("mapped_severity").alias("severity"))
        .groupBy("class_name", "severity")
        .agg(F.count(F.lit(1)).alias("events"))
    )


LENIENT = f"""
SELECT CASE WHEN win_id IN (4624,4625,4634) THEN 'Authentication' WHEN win_id IN (4688,4689) THEN 'Process Activity'
       WHEN win_id IN (4656,4663) THEN 'Object Access' WHEN win_id IN (4719,4739) THEN 'Policy Change' ELSE 'Unknown' END AS class_name,
  CASE level WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'LOW' WHEN 5 THEN 'INFO' ELSE 'UNKNOWN' END AS severity,
  count(*) AS events
FROM ({LOG_STATES}) s WHERE NOT refused AND n % 4 = 2 AND n % 29 <> 0 AND NOT faulty GROUP BY ALL
"""


def validated_events(spark, path):
    rows = ingest(raw_logs(spark, path), RULES, now()).filter(F.col("route") == "windows")
    return rows.select("n", "valid", F.concat_ws("; ", "violations").alias("violations"))


VALIDATED = f"""
SELECT n, violations = '' AS valid, violations FROM (
  SELECT n, CASE
    WHEN faulty OR class_uid = 0 THEN 'no schema for class 0'
    WHEN class_uid = 1001 THEN concat_ws('; ', CASE WHEN NOT has_data THEN 'actor.user.name: not of type string' END,
         CASE WHEN severity NOT IN ('CRITICAL','HIGH','MEDIUM','LOW') THEN 'severity: value not allowed' END)
    WHEN class_uid = 1002 THEN concat_ws('; ', CASE WHEN NOT (has_data AND n % 3 = 0) THEN 'process.name: not of type string' END)
    WHEN class_uid = 1003 THEN concat_ws('; ', CASE WHEN text IS NULL THEN 'message: not of type string' END)
    ELSE concat_ws('; ', CASE WHEN stamp IS NULL THEN 'time: not of type string' END,
         CASE WHEN n % 3 <> 0 THEN 'category: not of type string' END) END AS violations
  FROM ({MAPPED}) m) v
"""


def event_criticality(spark, path):
    return windows(spark, path).select("n", "event_id", "criticality")


CRITICALITY = f"SELECT n, CAST(win_id AS VARCHAR) AS event_id, criticality FROM ({MAPPED}) m"


def high_events(spark, path):
    return metrics.high_criticality(windows(spark, path)).select("n", "event_id")


HIGH_EVENTS = f"SELECT n, event_id FROM ({CRITICALITY}) c WHERE criticality = 'high'"


def received_per_source(spark, path):
    return metrics.per_source(processed(spark, path))


RECEIVED = f"SELECT coalesce(source, 'unknown') AS source_type, count(*) AS logs FROM ({DISPATCHED}) d GROUP BY 1"


def mapping_counts(spark, path):
    return metrics.mappings(processed(spark, path))


MAPPINGS = f"SELECT class_name AS event_class, 'success' AS status, count(*) AS mappings FROM ({MAPPED}) m WHERE NOT faulty GROUP BY 1"


def mapping_error_counts(spark, path):
    return metrics.mapping_errors(processed(spark, path))


MAPPING_ERRORS = f"SELECT 'TypeError' AS error_type, count(*) AS errors FROM ({MAPPED}) m WHERE faulty HAVING count(*) > 0"


def high_criticality_counts(spark, path):
    return metrics.high_criticality_counts(windows(spark, path))


HIGH_COUNTS = f"SELECT event_id, count(*) AS events FROM ({HIGH_EVENTS}) h GROUP BY 1"


def duration_histogram(spark, path):
    events = tables(spark, path)["events"]
    rows = metrics.histogram(events, "event_type", "value")
    return rows.withColumn("total_seconds", F.round("total_seconds", 2))


_LE = "0.005 0.01 0.025 0.05 0.075 0.1 0.25 0.5 0.75 1.0 2.5 5.0 7.5 10.0".split()
HISTOGRAM = f"""
SELECT event_type AS operation, CAST(le AS DOUBLE) AS le, count(CASE WHEN value <= le THEN 1 END) AS observations,
  round(sum(value), 2) AS total_seconds, count(value) AS total_count
FROM events CROSS JOIN (VALUES {', '.join(f'(CAST({v} AS DOUBLE))' for v in _LE)}, (CAST('Infinity' AS DOUBLE))) AS b(le)
GROUP BY event_type, le
"""


def backlog(spark, path):
    queued = processed(spark, path)
    return metrics.backlog(queued, queued.filter(F.col("route") == "file"))


BACKLOG = f"SELECT CAST(count(*) - count(CASE WHEN route = 'file' THEN 1 END) AS BIGINT) AS queue_size FROM ({DISPATCHED}) d"


def file_scan(spark, path):
    """Messages landed as log files, read back with the age limit of the agent."""
    out = scratch_path(spark, "log-files")
    view(spark, path, LOGS).select("event_type", "message").write.partitionBy("event_type").text(out)
    found = source.log_files(spark, f"{out}/*/*.txt", as_of=datetime.now(timezone.utc).replace(tzinfo=None))
    routed = process_logs(found, now())
    return routed.groupBy(
        "route", F.regexp_extract("file_path", "event_type=([^/]+)/", 1).alias("event_type"), "message"
    ).agg(F.count(F.lit(1)).alias("lines"))


FILE_SCAN = f"SELECT 'file' AS route, event_type, message, count(*) AS lines FROM ({LOGS}) l GROUP BY ALL"


def volume_alerts(spark, path):
    rows = windows(spark, path).select(F.to_timestamp("mapped_time").alias("time"), F.col("mapped_class_name").alias("class_name"))
    return monitoring.volume_alerts(rows.filter("time is not null"), "time", "class_name", 3, "6 hours")


VOLUME_ALERTS = f"""
SELECT to_timestamp(floor(epoch(t) / 21600) * 21600) AT TIME ZONE 'UTC' AS window_start, class_name, count(*) AS events FROM (
  SELECT CASE WHEN faulty THEN TIMESTAMP '2024-06-01 00:00:00' ELSE strptime(stamp, '%Y-%m-%dT%H:%M:%S.%gZ') END AS t,
    CASE WHEN faulty THEN 'Unknown' ELSE class_name END AS class_name FROM ({MAPPED}) m) x
WHERE t IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 3
"""


def events_over_time(spark, path):
    return monitoring.over_time(tables(spark, path)["events"], "ts", "day", "event_type")


OVER_TIME = "SELECT date_trunc('day', ts)::TIMESTAMP AS period, event_type, count(*) AS events FROM events GROUP BY ALL"


ENTRIES = {
    "class_counts": (class_counts, CLASS_COUNTS),
    "payload_records": (payload_records, PAYLOAD_RECORDS),
    "refused_payloads": (refused_payloads, REFUSED),
    "agent_normalize": (agent_normalize, AGENT_NORMALIZE),
    "agent_complete": (agent_complete, AGENT_COMPLETE),
    "syslog_lines": (syslog_lines, SYSLOG_LINES),
    "syslog_refused_lines": (syslog_refused_lines, SYSLOG_REFUSED),
    "windows_xml": (windows_xml, WINDOWS_XML),
    "windows_channels": (windows_channels, WINDOWS_CHANNELS),
    "critical_events": (critical_events, CRITICAL_EVENTS),
    "xml_to_mapped": (xml_to_mapped, XML_TO_MAPPED),
    "dispatched_logs": (dispatched_logs, DISPATCHED),
    "file_logs": one_source("file", "timestamp", "source", "file_path", "message", "host"),
    "syslog_logs": one_source("syslog", "timestamp", "source", "facility", "severity", "message", "host"),
    "generic_logs": one_source("generic", "timestamp", "source", "message", "host"),
    "windows_records": (windows_records, WINDOWS_RECORDS),
    "mapped_events": (mapped_events, MAPPED_EVENTS),
    "mapped_actor": ACTOR,
    "mapped_target": TARGET,
    "mapped_process": PROCESS,
    "mapped_authentication": AUTHENTICATION,
    "mapped_device": DEVICE,
    "error_records": (error_records, ERROR_RECORDS),
    "lenient_mapping": (lenient_mapping, LENIENT),
    "validated_events": (validated_events, VALIDATED),
    "event_criticality": (event_criticality, CRITICALITY),
    "high_events": (high_events, HIGH_EVENTS),
    "received_per_source": (received_per_source, RECEIVED),
    "mapping_counts": (mapping_counts, MAPPINGS),
    "mapping_error_counts": (mapping_error_counts, MAPPING_ERRORS),
    "high_criticality_counts": (high_criticality_counts, HIGH_COUNTS),
    "duration_histogram": (duration_histogram, HISTOGRAM),
    "backlog": (backlog, BACKLOG),
    "file_scan": (file_scan, FILE_SCAN),
    "volume_alerts": (volume_alerts, VOLUME_ALERTS),
    "events_over_time": (events_over_time, OVER_TIME),
}
