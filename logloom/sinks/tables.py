"""Append, upsert and delete on tables kept as Parquet or catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import stable_id


def append(frame: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Add rows to a table below ``path``, in folders of ``by``; the table as it is then."""
    writer = frame.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return frame.sparkSession.read.parquet(path)


def store_best(classified: DataFrame, path: str, time: str) -> DataFrame:
    """Best classes appended by the day of ``time``."""
    return append(classified.withColumn("day", F.date_format(time, "yyyy-MM-dd")), path, ["day"])


def store_answers(answers: DataFrame, path: str) -> DataFrame:
    """Event rows of answered questions appended to the event table."""
    return append(rag_events(answers), path)


def delete(current: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    return current.join(gone.select(*key).distinct(), list(key), "left_anti")


def queued(records: DataFrame, now: Column | None = None) -> DataFrame:
    """Stamp JSON records with the time they are queued, inside the record and beside it."""
    stamp = now if now is not None else F.current_timestamp()
    text = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    with_stamp = F.concat(
        F.regexp_replace("record", r"\}\s*$", ""),
        F.when(F.col("record").rlike(r"^\{\s*\}$"), '"queued_at":"').otherwise(',"queued_at":"'),
        text,
        F.lit('"}'),
    )
    return records.select(with_stamp.alias("record"), stamp.alias("queued_at"))


def rag_events(turns: DataFrame) -> DataFrame:
    """Event rows (event_type, user_message, llm_response) of answered questions."""
    return turns.select(
        stable_id("query", "response").alias("id"),
        F.lit("rag").alias("event_type"),
        F.col("query").alias("user_message"),
        F.col("response").alias("llm_response"),
    )


def mark_duplicates(searches: DataFrame, duplicates: DataFrame) -> DataFrame:
    """All searches with ``is_duplicate`` set on the given (dataset_id, id)."""
    flags = duplicates.select("dataset_id", "id").distinct().withColumn("_dup", F.lit(1))
    return (
        searches.join(flags, ["dataset_id", "id"], "left")
        .withColumn("is_duplicate", F.coalesce("_dup", F.col("is_duplicate")))
        .select(*searches.columns)
    )


def duplicate_rows(searches: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Full rows of the duplicates as new versions, to append to a table that keeps the last one."""
    return searches.join(duplicates, ["dataset_id", "id"], "left_semi").withColumn(
        "is_duplicate", F.lit(1)
    )


def high_water(scanned: DataFrame) -> DataFrame:
    """New mark rows: the newest search seen per dataset."""
    return scanned.groupBy("dataset_id").agg(F.max("created_at").alias("last_collapsed")).select(
        stable_id("dataset_id", "last_collapsed").alias("id"),
        "last_collapsed",
        "dataset_id",
        F.col("last_collapsed").alias("created_at"),
    )
