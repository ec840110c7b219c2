"""From ingest payloads to normalised, mapped and validated records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.dispatch import process_logs
from logloom.operators.validation import Rule, validate
from logloom.sources.logs import payloads


def ingest(
    raw: DataFrame,
    rules: Iterable[Rule] | None = None,
    now: Column | None = None,
    value: str = "raw",
    strict: bool = True,
) -> DataFrame:
    """Processed records of a batch or a stream of payloads; one projection, no shuffle."""
    processed = process_logs(payloads(raw, value), now, strict)
    if rules is None:
        return processed
    checked = validate(processed, rules)
    windows = F.col("route") == "windows"
    return checked.withColumn("valid", F.when(windows, F.col("valid"))).withColumn(
        "violations", F.when(windows, F.col("violations"))
    )
