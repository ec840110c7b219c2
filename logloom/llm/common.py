"""Helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Bytes of a batch that a Python worker gets at a time
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of bounded size, however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(frame: DataFrame, name: str) -> str:
    """A column name the frame does not have, whatever the case of its letters."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(id_col: str = "doc_id") -> Column:
    """Rows set aside for tests: crc32 of the id as text divisible by 5; a null id never is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of every node's component, of ``n`` nodes joined by edges ``a[i]-b[i]``."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]
    return label


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches regrouped so that equal ``keys`` never straddle two tables.

    Holds one batch and one group, so groups must be bounded.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = pa.Table.from_batches([batch])
        if rest is not None:
            piece = pa.concat_tables([rest, piece])
        start = group_starts(piece, keys)[-1]
        if start:
            yield piece.slice(0, start)
        rest = piece.slice(start).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a new group begins in rows sorted by integer ``keys``."""
    change = np.zeros(rows.num_rows, dtype=bool)
    change[0] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


# Bytes up to which a measured frame is broadcast; larger ones are joined by shuffle
BROADCAST_BYTES = 16 << 20


def small_if_measured(frame: DataFrame, row_bytes: Column | int) -> DataFrame:
    """The frame with a broadcast hint if its measured size allows it; it should be materialised."""
    size = frame.agg(F.coalesce(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes), F.lit(0))).first()[0]
    return F.broadcast(frame) if size <= BROADCAST_BYTES else frame
