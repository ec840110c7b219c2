"""Input views of the queries, in SQL that Spark and DuckDB both run, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Raw logs: every event becomes a log of one of four sources, in many states of completeness.
LOGS = """
SELECT e.event_id AS n, e.ts, e.user_id, e.event_type, e.value,
  CASE e.event_id % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'syslog'
       WHEN 2 THEN 'windows_event_log' ELSE 'other' END AS source_type,
  w.win_id,
  CASE WHEN e.event_id % 11 = 0 THEN NULL
       ELSE 1 + CAST(floor(e.event_id / 4) AS BIGINT) % 6 END AS level,
  CASE CAST(floor(e.event_id / 4) AS BIGINT) % 4 WHEN 0 THEN 'Audit Success'
       WHEN 1 THEN 'Audit Failure' WHEN 2 THEN 'Audit Failure, Audit Success' ELSE NULL END AS keywords,
  concat('host-', CAST(e.user_id % 20 AS VARCHAR(20))) AS computer,
  concat(e.event_type, ' by user ', CAST(e.user_id AS VARCHAR(20))) AS message
FROM events e JOIN (VALUES (0,4624),(1,4625),(2,4634),(3,4688),(4,4689),(5,4656),(6,4663),
  (7,4719),(8,4739),(9,4618),(10,1102),(11,4621),(12,550),(13,9999)) AS w(i, win_id)
  ON CAST(floor(e.event_id / 4) AS BIGINT) % 14 = w.i
"""

# Search log: keystrokes of every turn, three characters at a time, then its whole text.
SEARCHES = """
SELECT concat('q-', CAST(conv_id AS VARCHAR(20)), '-', CAST(turn AS VARCHAR(20)), '-', CAST(k AS VARCHAR(20))) AS id,
  CASE WHEN k = 33 THEN text ELSE substr(text, 1, k) END AS query,
  CAST((conv_id * 31 + turn * 17 + k) % 1000 AS DOUBLE) / 1000 AS top_score,
  1704067200 + conv_id * 120 + turn * 15 + CAST(floor(k / 3) AS BIGINT) AS created_at,
  CASE WHEN conv_id % 7 = 0 THEN 'rag' ELSE 'search' END AS search_type,
  0 AS is_duplicate, concat('ds', CAST(conv_id % 4 AS VARCHAR(20))) AS dataset_id
FROM conversations
CROSS JOIN (VALUES (3),(6),(9),(12),(15),(18),(21),(24),(27),(30),(33)) AS p(k)
WHERE k = 33 OR char_length(text) >= k
"""

# Marks for the incremental run: two runs per dataset, the later one counts; ds3 never ran.
MARKS = f"""
SELECT dataset_id, CAST(min(created_at) + run * floor((max(created_at) - min(created_at)) / 2) AS BIGINT) AS last_collapsed,
  run AS created_at
FROM ({SEARCHES}) s CROSS JOIN (VALUES (0),(1)) AS r(run)
WHERE dataset_id <> 'ds3'
GROUP BY dataset_id, run
"""

CLASSES = """
SELECT c_custkey AS pos, c_custkey AS uid, concat('c', CAST(c_custkey AS VARCHAR(20))) AS name,
  c_mktsegment AS category,
  CASE WHEN c_custkey % 50 = 0 THEN NULL
       WHEN c_custkey % 97 = 1 THEN c_custkey + 10000000
       WHEN c_custkey % 400 = 7 THEN c_custkey + 1
       WHEN c_custkey % 400 = 8 THEN c_custkey - 1
       WHEN c_custkey % 400 IN (107, 108) THEN c_custkey + 1
       WHEN c_custkey % 400 = 109 THEN c_custkey - 2
       ELSE CAST(floor((c_custkey - 1) / 2) AS BIGINT) END AS extends
FROM customer
"""

FIELDS = """
SELECT o_custkey AS class_uid, o_custkey AS class_pos, o_orderkey AS pos,
  concat('f', CAST(o_orderkey % 40 AS VARCHAR(20))) AS name,
  CASE WHEN o_orderkey % 5 = 0 THEN 'enum' ELSE concat('t_', o_orderstatus) END AS type,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('e', CAST(o_orderkey % 12 AS VARCHAR(20))) END AS enum_name,
  CASE WHEN o_orderkey % 5 <> 0 THEN NULL WHEN o_orderkey % 12 < 6 THEN 'v0'
       ELSE concat('v', CAST(o_orderkey % 7 AS VARCHAR(20))) END AS enum_value,
  CASE WHEN o_orderkey % 101 = 0 THEN o_custkey + 10000000
       WHEN o_orderkey % 10 = 1 THEN o_custkey END AS ref,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('x', CAST(o_orderkey AS VARCHAR(20)))
       WHEN o_orderkey % 3 = 1 THEN '' END AS example,
  (o_orderpriority = '1-URGENT') AS required
FROM orders
"""

# Two fields per order line, named by line number: each pair occurs in the same orders.
PAIRED_FIELDS = """
SELECT l_orderkey AS class_uid, concat(f.prefix, CAST(l_linenumber AS VARCHAR(20))) AS name
FROM lineitem CROSS JOIN (VALUES ('a'),('b')) AS f(prefix)
"""

# Base event: one entry per part
BASE_FIELDS = """
SELECT p_partkey AS entry, p_partkey AS pos, concat('b', CAST(p_partkey AS VARCHAR(20))) AS name,
  p_type AS type_name,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS grp,
  CASE p_size % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'recommended' WHEN 2 THEN 'optional' END AS requirement
FROM part
"""

CATEGORIES = """
SELECT c_mktsegment AS name, min(c_custkey) AS pos, concat('u', CAST(min(c_custkey) AS VARCHAR(20))) AS uid
FROM customer GROUP BY c_mktsegment
UNION ALL
SELECT concat('empty ', n_name) AS name, 1000000000 + n_nationkey AS pos, concat('n', CAST(n_nationkey AS VARCHAR(20))) AS uid
FROM nation
"""

CHUNKS = """
SELECT doc_id AS chunk_id, text AS content, lang, source FROM documents
"""

QUERIES = """
SELECT item_id AS query_id, text AS query FROM benchmark
"""


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}.parquet") for t in TABLES}


def view(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """Run a view's SQL over the Parquet tables below ``path``, without naming session views."""
    import re

    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    text = re.sub(
        rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", lambda m: f"{m.group(1)} {{{m.group(2)}}}", sql
    )
    return spark.sql(text, **{t: spark.read.parquet(f"{path}/{t}.parquet") for t in used})


def raw_logs(spark: SparkSession, path: str) -> DataFrame:
    """(n, raw): ingest payloads as JSON text, in the states LOG_STATES describes."""
    logs = view(spark, path, LOGS)
    n = F.col("n")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def json(*entries: tuple[str, object]) -> F.Column:
        parts = [
            F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value)) for key, value in entries
        ]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    def quoted(c) -> F.Column:
        return F.concat(F.lit('"'), c if isinstance(c, F.Column) else F.col(c), F.lit('"'))

    windows = n % 4 == 2
    number = F.col("win_id").cast("string")
    level = F.col("level").cast("string")
    event_data = json(
        ("SubjectUserName", quoted(F.concat(F.lit("u"), F.col("user_id")))),
        ("TargetUserName", quoted(F.concat(F.lit("u"), F.col("user_id") + 1))),
        ("IpAddress", quoted(F.concat(F.lit("10.0.0."), F.col("user_id") % 250))),
        ("WorkstationName", quoted("computer")),
        ("ProcessName", F.when(n % 3 == 0, quoted("event_type"))),
        ("LogonType", (n % 12).cast("string")),
    )
    record = json(
        ("source_type", quoted("source_type")),
        ("timestamp", F.when(n % 31 != 3, quoted(stamp))),
        ("message", F.when(n % 37 != 5, quoted("message"))),
        ("host", F.when(n % 5 == 1, F.lit("null")).when(n % 5 != 0, quoted("computer"))),
        ("file", F.when(n % 12 == 0, json(("path", quoted(F.concat(F.lit("/var/log/"), F.col("event_type"), F.lit(".log")))))).when(n % 12 == 4, F.lit('"plain"'))),
        ("facility", F.when(n % 8 == 1, quoted(F.lit("auth")))),
        ("severity", F.when(n % 8 == 5, F.lit("null")).when(n % 8 == 1, quoted(F.lit("err")))),
        ("event_id", F.when(windows & (n % 17 == 0), quoted(number)).when(windows, number)),
        ("level", F.when(windows & (n % 13 == 0), quoted(level)).when(windows, level)),
        ("keywords", F.when(windows & (n % 19 == 0), F.lit("5")).when(windows, quoted("keywords"))),
        ("computer", F.when(windows, quoted("computer"))),
        ("task_category", F.when(windows & (n % 3 == 0), quoted(F.lit("Logon")))),
        ("version", F.when(windows, F.lit("2"))),
        ("execution", F.when(windows, json(("process_id", (n % 1000).cast("string"))))),
        ("event_data", F.when(windows & (n % 29 == 0), F.lit('"none"')).when(windows & (n % 23 != 0), event_data)),
    )
    text = F.col("record")
    raw = (
        F.when(n % 97 == 0, F.concat(F.lit("not json "), F.col("message")))
        .when(n % 89 == 0, F.concat(F.lit("["), text, F.lit(",7]")))
        .when(n % 3 == 0, F.concat(F.lit("["), text, F.lit("]")))
        .when(n % 50 == 7, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"')))
        .otherwise(text)
    )
    return logs.select("n", "message", record.alias("record")).select("n", raw.alias("raw"))


# The same states for the oracle, as columns. A payload is refused when it is no JSON or mixes records and numbers.
LOG_STATES = f"""
SELECT l.*, (n % 97 = 0 OR n % 89 = 0) AS refused,
  CASE WHEN n % 31 <> 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS stamp,
  CASE WHEN n % 37 <> 5 THEN message END AS text,
  CASE WHEN n % 5 = 0 THEN 'unknown' WHEN n % 5 = 1 THEN NULL ELSE computer END AS host,
  CASE WHEN n % 12 = 0 THEN 'file' WHEN n % 12 = 8 THEN 'file' WHEN n % 4 = 1 THEN 'syslog'
       WHEN n % 4 = 2 AND n % 29 <> 0 THEN 'windows' ELSE 'generic' END AS route,
  CASE WHEN n % 17 <> 0 THEN win_id END AS known_id,
  CASE WHEN n % 13 <> 0 THEN level END AS known_level,
  (n % 23 <> 0) AS has_data,
  (n % 19 = 0) AS faulty
FROM ({LOGS}) l
"""

# Mapped Windows events as columns
MAPPED = f"""
SELECT n, win_id, known_id, computer, user_id, event_type, text, stamp, has_data, faulty,
  CASE WHEN known_id IN (4624,4625,4634) THEN 1001 WHEN known_id IN (4688,4689) THEN 1002
       WHEN known_id IN (4656,4663) THEN 1003 WHEN known_id IN (4719,4739) THEN 1004 ELSE 0 END AS class_uid,
  CASE WHEN known_id IN (4624,4625,4634) THEN 'Authentication' WHEN known_id IN (4688,4689) THEN 'Process Activity'
       WHEN known_id IN (4656,4663) THEN 'Object Access' WHEN known_id IN (4719,4739) THEN 'Policy Change' ELSE 'Unknown' END AS class_name,
  CASE known_id WHEN 4624 THEN 'User Logon' WHEN 4625 THEN 'User Logon Failure' WHEN 4634 THEN 'User Logoff'
       WHEN 4688 THEN 'Process Creation' WHEN 4689 THEN 'Process Termination' WHEN 4656 THEN 'Handle Requested'
       WHEN 4663 THEN 'Object Access Attempt' WHEN 4719 THEN 'System Audit Policy Changed'
       WHEN 4739 THEN 'Domain Policy Changed' ELSE 'Unknown' END AS activity_name,
  CASE known_level WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'LOW' WHEN 5 THEN 'INFO' ELSE 'UNKNOWN' END AS severity,
  CASE WHEN keywords LIKE '%Audit Success%' THEN 'SUCCESS' WHEN keywords LIKE '%Audit Failure%' THEN 'FAILURE' ELSE 'UNKNOWN' END AS status,
  CASE WHEN known_id IN (517,550,1102,4618,4649,4719,4765,4766,4794,4897,4964) THEN 'high'
       WHEN known_id IN (4621,4675,4692,4693) THEN 'medium' ELSE 'low' END AS criticality
FROM ({LOG_STATES}) s WHERE NOT refused AND route = 'windows'
"""
