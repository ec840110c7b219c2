"""Fixed lookup values. They must equal the published ones for right results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event id -> (class uid, class name, activity name)
EVENT_CLASSES = {
    4624: (1001, "Authentication", "User Logon"),
    4625: (1001, "Authentication", "User Logon Failure"),
    4634: (1001, "Authentication", "User Logoff"),
    4656: (1003, "Object Access", "Handle Requested"),
    4663: (1003, "Object Access", "Object Access Attempt"),
    4688: (1002, "Process Activity", "Process Creation"),
    4689: (1002, "Process Activity", "Process Termination"),
    4719: (1004, "Policy Change", "System Audit Policy Changed"),
    4739: (1004, "Policy Change", "Domain Policy Changed"),
}
UNKNOWN_CLASS = (0, "Unknown", "Unknown")

# Event ids per criticality; every other id is low
HIGH_EVENTS = (517, 550, 1102, 4618, 4649, 4719, 4765, 4766, 4794, 4897, 4964)
MEDIUM_EVENTS = (4621, 4675, 4692, 4693)

# Ids the agent's critical-event filter lets through
FORWARDED_EVENTS = (1102, 4618, 4649, 4719, 4765, 4766, 4794, 4897, 4964)

# Channels read from Windows hosts
CHANNELS = (
    "Application",
    "DNS Server",
    "Directory Service",
    "File Replication Service",
    "Security",
    "System",
)

# Level -> severity
SEVERITIES = {1: "CRITICAL", 2: "HIGH", 3: "MEDIUM", 4: "LOW", 5: "INFO"}

RECORD_TYPE = 400001


def class_of(event_id: str, classes: dict | None = None) -> Column:
    """Struct (uid, name, activity) of an event id column. A literal map: no join, no shuffle."""

    def entry(uid: int, name: str, activity: str) -> str:
        return f"named_struct('uid', {uid}, 'name', {_quoted(name)}, 'activity', {_quoted(activity)})"

    known = ", ".join(f"{key}L, {entry(*value)}" for key, value in (classes or EVENT_CLASSES).items())
    return F.expr(f"coalesce(try_element_at(map({known}), cast({event_id} AS bigint)), {entry(*UNKNOWN_CLASS)})")


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def criticality_of(event_id: str, high=HIGH_EVENTS, medium=MEDIUM_EVENTS) -> Column:
    ids = [", ".join(map(str, group)) for group in (high, medium)]
    return F.expr(
        f"CASE WHEN {event_id} IN ({ids[0]}) THEN 'high' WHEN {event_id} IN ({ids[1]}) THEN 'medium' ELSE 'low' END"
    )
