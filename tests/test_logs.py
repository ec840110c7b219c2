import datetime
import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import variant as V
from logloom.operators import agent, mapping, validation
from logloom.operators.dispatch import process_logs, record_json
from logloom.plans.ingest import ingest
from logloom.sinks.tables import queued
from logloom.sources import catalogue, logs


def docs(spark, *records):
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "n int, raw string").withColumn("doc", F.try_parse_json("raw"))


def now():
    return F.lit("2024-01-02 03:04:05").cast("timestamp")


def test_missing_is_not_null(spark):
    frame = docs(spark, {"a": None}, {}, {"a": "x"}, {"a": 5}, {"a": {"b": 1}})
    rows = frame.select(
        V.get_or("doc", "$.a", "d").alias("v"), V.is_null("doc", "$.a").alias("null"), V.is_object("doc", "$.a").alias("o")
    ).collect()
    assert [r.v for r in rows] == [None, "d", "x", "5", '{"b":1}']
    assert [r.null for r in rows] == [True, False, False, False, False]
    assert [r.o for r in rows] == [False, False, False, False, True]


def test_payload_shapes(spark):
    raw = ['{"a":1}', '[{"a":1},{"a":2}]', "[]", "[1]", "nope", '"{\\"a\\":3}"', ' \n{"a":4}', "7", None, '[{"a":1},"x"]']
    frame = spark.createDataFrame(list(enumerate(raw)), "n int, raw string")
    got = logs.payloads(frame).select("n", "item", V.get("doc", "$.a", "int").alias("a")).collect()
    assert sorted((r.n, r.item, r.a) for r in got) == [(0, 0, 1), (1, 0, 1), (1, 1, 2), (5, 0, 3), (6, 0, 4)]
    assert sorted(r.n for r in logs.refused(frame).collect()) == [3, 4, 7, 8, 9]


EVENT = {
    "source_type": "windows_event_log", "event_id": 4624, "level": 1, "keywords": "Audit Failure, Audit Success",
    "timestamp": "t", "message": "m", "computer": "pc", "task_category": "Logon",
    "event_data": {"SubjectUserName": "bob", "TargetUserName": "eve", "IpAddress": "1.2.3.4", "IpPort": 99, "LogonType": 2},
}


def event(**changes):
    return {k: v for k, v in {**EVENT, **changes}.items() if v != "absent"}


def test_published_mappings(spark):
    frame = docs(spark, *[event(event_id=i) for i in (4624, 4625, 4688, 9999, "4624", 4624.0)])
    rows = mapping.map_events(frame, now=now()).orderBy("n").collect()
    assert [(r.mapped_class_uid, r.mapped_class_name, r.mapped_activity_name) for r in rows] == [
        (1001, "Authentication", "User Logon"), (1001, "Authentication", "User Logon Failure"),
        (1002, "Process Activity", "Process Creation"), (0, "Unknown", "Unknown"), (0, "Unknown", "Unknown"),
        (1001, "Authentication", "User Logon"),
    ]
    lenient = mapping.map_events(frame, now=now(), strict=False).orderBy("n").collect()
    assert lenient[4].mapped_class_uid == 1001
    record = rows[0]
    assert record.mapped_actor.user.name == "bob" and record.mapped_actor.user.type == "Windows"
    assert record.mapped_target.user.name == "eve" and record.mapped_device.ip == "1.2.3.4"
    assert record.mapped_device.port == "99" and record.mapped_authentication.logon_type == "2"
    assert record.mapped_category == "Logon" and record.mapped_type_uid == 400001


@pytest.mark.parametrize(
    "level, severity",
    [(1, "CRITICAL"), (5, "INFO"), (0, "UNKNOWN"), (6, "UNKNOWN"), (None, "UNKNOWN"), ("4", "UNKNOWN"), (2.0, "HIGH"),
     (2.5, "UNKNOWN"), (True, "CRITICAL"), ("absent", "UNKNOWN")],
)
def test_severity(spark, level, severity):
    assert mapping.map_events(docs(spark, event(level=level)), now=now()).first().mapped_severity == severity


@pytest.mark.parametrize(
    "keywords, status",
    [("Audit Failure, Audit Success", "SUCCESS"), ("x Audit Failure", "FAILURE"), ("", "UNKNOWN"), (None, "UNKNOWN"),
     (["Audit Success"], "SUCCESS"), (["x Audit Success"], "UNKNOWN"), ({"Audit Failure": 1}, "FAILURE"), ([], "UNKNOWN"),
     (0, "UNKNOWN"), (False, "UNKNOWN"), ("absent", "UNKNOWN")],
)
def test_status(spark, keywords, status):
    row = mapping.map_events(docs(spark, event(keywords=keywords)), now=now()).first()
    assert (row.mapped_status, row.map_status) == (status, "success")


@pytest.mark.parametrize(
    "changes, kind, text",
    [
        ({"keywords": 5}, "TypeError", "argument of type 'int' is not iterable"),
        ({"keywords": True}, "TypeError", "argument of type 'bool' is not iterable"),
        ({"keywords": 1.5}, "TypeError", "argument of type 'float' is not iterable"),
        ({"event_data": "x"}, "AttributeError", "'str' object has no attribute 'get'"),
        ({"event_data": None}, "AttributeError", "'NoneType' object has no attribute 'get'"),
        ({"level": [1]}, "TypeError", "unhashable type: 'list'"),
        ({"event_id": {"a": 1}, "level": [1]}, "TypeError", "unhashable type: 'dict'"),
    ],
)
def test_error_records(spark, changes, kind, text):
    row = mapping.map_events(docs(spark, event(**changes)), now=now()).first()
    assert (row.map_status, row.map_error_type, row.mapped_metadata.error) == ("error", kind, text)
    assert (row.mapped_class_uid, row.mapped_class_name, row.mapped_severity) == (0, "Unknown", "ERROR")
    assert row.mapped_message == f"Failed to map event: {text}" and row.mapped_time == "2024-01-02T03:04:05.000000"
    assert row.mapped_actor is None and row.mapped_type_uid is None


def test_dispatch(spark):
    frame = docs(
        spark,
        {"source_type": "file", "file": {"path": "/x"}, "host": None},
        {"source_type": "file", "file": "/x", "message": "m"},
        {"source_type": "file"},
        {"source_type": "syslog", "facility": "auth", "severity": None},
        {"source_type": "other", "timestamp": None},
        {},
        event(event_data="x"),
        event(event_data="absent"),
        event(execution=7),
        {"source_type": ["file"]},
    )
    rows = process_logs(frame, now()).orderBy("n").collect()
    assert [r.route for r in rows] == [
        "file", "generic", "file", "syslog", "generic", "generic", "generic", "windows", "generic", "generic",
    ]
    assert (rows[0].file_path, rows[0].metadata.host, rows[0].message, rows[0].timestamp) == ("/x", None, "", None)
    assert (rows[1].source, rows[1].message, rows[1].metadata.host) == ("unknown", "m", "unknown")
    assert rows[2].file_path == "unknown" and (rows[3].facility, rows[3].severity) == ("auth", None)
    assert rows[4].timestamp is None and rows[5].timestamp == "2024-01-02T03:04:05.000000"
    assert rows[7].mapped_class_name == "Authentication" and rows[7].source is None and rows[7].metadata is None


def test_record_json_and_queue_stamp(spark):
    frame = docs(spark, {"source_type": "file", "file": {"path": "/x"}}, event(), event(keywords=5))
    out = queued(record_json(process_logs(frame, now())), now()).collect()
    parsed = [json.loads(r.record) for r in out]
    assert {tuple(sorted(p)) for p in parsed} >= {("file_path", "message", "metadata", "queued_at", "source", "timestamp")}
    by_class = {p.get("class_name"): p for p in parsed}
    assert by_class["Authentication"]["actor"]["user"]["name"] == "bob"
    assert by_class["Authentication"]["metadata"]["original_event"]["event_id"] == 4624
    assert by_class["Unknown"]["metadata"]["error"].startswith("argument of type")
    assert all(p["queued_at"] == "2024-01-02T03:04:05.000000" for p in parsed)


def test_validation(spark):
    rules = [
        validation.Rule(1001, "actor.user.name", True, "string"),
        validation.Rule(1001, "activity_id", True, "integer"),
        validation.Rule(1001, "nothing.here", True),
        validation.Rule(1001, "severity", allowed=("CRITICAL",)),
        validation.Rule(1001, "metadata.original_event.level", True, "number"),
    ]
    table = spark.createDataFrame(
        [(r.class_uid, r.path, r.required, r.type, list(r.allowed) if r.allowed else None) for r in rules],
        "class_uid int, path string, required boolean, type string, allowed array<string>",
    )
    assert sorted(validation.load_rules(table), key=str) == sorted(rules, key=str)
    raw = spark.createDataFrame(
        [(0, json.dumps(event())), (1, json.dumps(event(event_data="absent", level="3"))), (2, json.dumps(event(event_id=9)))],
        "n int, raw string",
    )
    rows = ingest(raw, rules, now()).orderBy("n").collect()
    assert rows[0].violations == ["nothing.here: required"] and rows[0].valid is False
    assert rows[1].violations == [
        "actor.user.name: not of type string", "nothing.here: required", "severity: value not allowed",
        "metadata.original_event.level: not of type number",
    ]
    assert rows[2].violations == ["no schema for class 0"]
    good = ingest(raw, [rules[0], rules[3]], now()).orderBy("n").first()
    assert good.valid is True and good.violations == []


def test_agent(spark):
    frame = docs(
        spark,
        {"message": '{"timestamp":"2024-01-01 00:00:01.5","eventID":1,"message":"in"}', "timestamp": "bad"},
        {"message": "plain", "timestamp": "2024-01-01T00:00:00Z", "event_id": 3, "eventID": 4},
        {"message": "[1]", "timestamp": "never"},
        {"message": None, "timestamp": "2024-01-01T00:00:00Z"},
        {"message": "x"},
    )
    out = agent.normalize(frame, "file")
    rows = [json.loads(r[0]) for r in out.orderBy("n").select(F.to_json("doc")).collect()]
    assert rows[0] == {"timestamp": "2024-01-01T00:00:01.500Z", "event_id": 1, "message": "in", "source_type": "file", "normalized": True}
    assert rows[1]["event_id"] == 4 and "eventID" not in rows[1]
    assert rows[2] == {"message": "[1]", "timestamp": "never"}
    assert sorted(r.n for r in agent.complete(out).collect()) == [0, 1, 2]


def test_syslog(spark):
    lines = ["<34>1 2003-10-11T22:14:15.003Z host su - ID47 [a b=\"c\"] failed", "<13>Feb  5 17:32:18 box test: hi", "<200>x", "plain", "y" * 65_537, "<165>1 - - - - - - nothing"]
    got = {r.value: r for r in logs.syslog(spark.createDataFrame([(x,) for x in lines], "value string"), year=2024).collect()}
    assert len(got) == 5
    first = got[lines[0]]
    assert (first.facility, first.severity, first.host, first.timestamp, first.message) == ("auth", "crit", "host", "2003-10-11T22:14:15.003Z", "failed")
    second = got[lines[1]]
    assert (second.facility, second.severity, second.host, second.timestamp, second.message) == ("user", "notice", "box", "2024-02-05T17:32:18.000Z", "test: hi")
    assert got["<200>x"].facility is None and got["plain"].message == "plain"
    assert (got[lines[5]].host, got[lines[5]].timestamp, got[lines[5]].message) == (None, None, "nothing")
    routed = process_logs(logs.syslog_documents(logs.syslog(spark.createDataFrame([("plain",)], "value string"))), now()).first()
    assert (routed.route, routed.facility, routed.metadata.host) == ("syslog", "unknown", "unknown")


def test_windows_xml(spark):
    good = "<Event><System><EventID>4625</EventID><Level>2</Level><Channel>Security</Channel><TimeCreated SystemTime=\"2024-01-01T00:00:00.5Z\"/></System><EventData><Data Name=\"A\">1</Data><Data Name=\"A\">2</Data><Data>loose</Data></EventData></Event>"
    frame = spark.createDataFrame([(0, good), (1, "<Event><System>"), (2, good.replace("4625", "x"))], "n int, message string")
    rows = agent.windows_columns(frame).orderBy("n").collect()
    assert (rows[0].event_id, rows[0].level, rows[0].timestamp, rows[0].parsed) == (4625, 2, "2024-01-01T00:00:00.500Z", True)
    assert (rows[1].parsed, rows[1].event_id, rows[2].event_id) == (False, None, None)
    mapped = process_logs(agent.windows_documents(agent.windows_columns(frame)), now()).orderBy("n").collect()
    assert [r.mapped_class_name for r in mapped] == ["Authentication", "Unknown"]
    assert json.loads(mapped[0].mapped_metadata.original_event.toJson())["event_data"] == {"A": "2"}


def test_file_scan(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    old = tmp_path / "b.log"
    old.write_text("old\n")
    import os

    os.utime(old, (1_600_000_000, 1_600_000_000))
    found = logs.log_files(spark, str(tmp_path / "*.log"), logs.IGNORE_OLDER_SECS)
    rows = process_logs(found, now()).collect()
    assert sorted(r.message for r in rows) == ["one", "two"]
    assert all(r.route == "file" and r.file_path.endswith("a.log") for r in rows)
    assert logs.log_files(spark, str(tmp_path / "*.log")).count() == 3
    assert logs.log_files(spark, str(tmp_path / "*.log"), 600, datetime.datetime(2020, 9, 13, 12, 30)).count() == 3


def test_catalogue_shapes(spark, tmp_path):
    cats = {"attributes": {"z": {"uid": 1, "classes": {"c2": {}, "c1": {}}}, "a": {"uid": 2, "description": None}}}
    (tmp_path / "cats.json").write_text(json.dumps(json.dumps(cats)))
    docs_ = catalogue.documents(spark, str(tmp_path / "cats.json"))
    got = catalogue.categories(docs_).orderBy("pos").collect()
    assert [(r.name, r.uid, r.description) for r in got] == [("z", "1", ""), ("a", "2", None)]
    assert [(r.category, r.pos.part, r.class_name) for r in catalogue.category_classes(docs_).orderBy("pos").collect()] == [("z", 0, "c2"), ("z", 1, "c1")]
    listed = [{"uid": 1, "name": "n", "extends": None, "fields": [{"name": "f", "type": "enum", "values": ["a"], "ref": None}]}, {"extends": ""}]
    for body in (listed, {"attributes": {"n": listed[0], "m": listed[1]}}):
        (tmp_path / "classes.json").write_text(json.dumps(body))
        table = catalogue.classes(catalogue.documents(spark, str(tmp_path / "classes.json"))).orderBy("pos")
        rows = table.collect()
        assert (rows[0].name, rows[0].extends, rows[0].extends_present, rows[1].extends) == ("n", None, True, "")
        assert rows[1].name == ("unnamed" if body is listed else "m") and rows[1].category == "unknown"
        field = catalogue.fields(table).first()
        assert (field.name, field["values"], field.ref, field.ref_present, field.required) == ("f", ["a"], None, True, False)
    (tmp_path / "one.json").write_text(json.dumps(listed[0]))
    assert catalogue.classes(catalogue.documents(spark, str(tmp_path / "one.json"))).count() == 1
    base = {"attributes": [{"time": {"type": "t", "group": "g", "requirement": "required"}}, {"x": {}}]}
    (tmp_path / "base.json").write_text(json.dumps(base))
    fields = catalogue.base_fields(catalogue.documents(spark, str(tmp_path / "base.json"))).orderBy("pos").collect()
    assert [(f.name, f.type, f.type_name, f.group, f.requirement, f.source) for f in fields] == [
        ("time", "t", "Unknown", "g", "required", "unknown"), ("x", "unknown", "Unknown", "uncategorized", "optional", "unknown"),
    ]
    (tmp_path / "base_list.json").write_text(json.dumps(base["attributes"]))
    assert catalogue.base_fields(catalogue.documents(spark, str(tmp_path / "base_list.json"))).count() == 2


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\ntwo\n")
    (tmp_path / "in" / "b.log").write_text("three\n")
    stream = logs.log_file_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    query = (
        stream.selectExpr("to_json(doc) AS value")
        .writeStream.format("text")
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(r["message"] for r in rows) == ["one", "three", "two"]
    assert {r["source_type"] for r in rows} == {"file"} and query.lastProgress["batchId"] == 1


def test_oversize_syslog_is_refused(spark):
    lines = spark.createDataFrame([("<13>short",), ("<13>" + "x" * 100,), (None,)], "value string")
    assert logs.syslog(lines, max_bytes=50).count() == 2
    assert [r.error_type for r in logs.syslog_refused(lines, max_bytes=50).collect()] == ["oversize"]
    assert logs.syslog(lines, max_bytes=None).count() == 3


def test_volume_alerts_on_a_stream_with_late_rows(spark, tmp_path):
    """Rows behind the watermark do not count any more; a window is given out once it is over."""
    from logloom.operators.monitoring import volume_alerts

    base = 1_717_200_000
    batches = [
        [(base + s, "a") for s in (0, 10, 20, 30)] + [(base + 40, "b")],
        [(base + 900, "a")],
        # of the first window: too late by then
        [(base + s, "b") for s in (1, 2, 3, 4)] + [(base + 901, "a"), (base + 902, "a"), (base + 903, "a")],
        [(base + 3600, "b")],
        [(base + 7200, "b")],
    ]
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "s long, class_name string").selectExpr("timestamp_seconds(s) AS time", "class_name")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/batch={n}")
        stream = spark.readStream.schema("time timestamp, class_name string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = (
            volume_alerts(stream, "time", "class_name", 3, "5 minutes", late="10 minutes")
            .writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/c")
            .trigger(availableNow=True).start(f"{tmp_path}/out")
        )
        query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").selectExpr("unix_seconds(window_start) AS s", "class_name", "events").collect()
    assert sorted(map(tuple, got)) == [(base, "a", 4), (base + 900, "a", 4)]
