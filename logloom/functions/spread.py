"""Building blocks that keep one hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import cut_lineage, shuffle_width

# A key is hot if it holds more than one row in HOT_SHARE and no fewer than HOT_ROWS
HOT_ROWS = 1000
HOT_SHARE = 1000


def lookup(
    facts: DataFrame,
    per_key: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    ways: int | None = None,
) -> DataFrame:
    """Join many ``facts`` to at most one ``per_key`` row per key, for a ``per_key`` much smaller.

    A key that holds a third of the facts is split ``ways`` times, by default as
    often as there are shuffle partitions, by a hash of ``spread_by`` (columns that differ within the key); every row of ``per_key``
    is copied to each part. Where the adaptive planner finds ``per_key`` below
    its broadcast limit it may still broadcast it.
    """
    ways = ways or shuffle_width(facts.sparkSession)
    salted = facts.withColumn("_part", F.pmod(F.xxhash64(*spread_by), F.lit(ways)).cast("int"))
    copies = per_key.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return salted.join(copies, [*on, "_part"], how).drop("_part")


def lookup_large(
    facts: DataFrame,
    per_key: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    ways: int | None = None,
) -> DataFrame:
    """The same for a ``per_key`` about as large as the facts: only hot keys are split.

    A key is hot if it holds more than one in ``HOT_SHARE`` of the facts, so
    there are fewer than ``HOT_SHARE`` hot keys whatever the data, and their
    list is small enough to broadcast. Only their rows of ``per_key`` are copied,
    ``ways`` times, by default as often as there are shuffle partitions.
    """
    ways = ways or shuffle_width(facts.sparkSession)
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = F.broadcast(
        counts.withColumn("_total", total)
        .filter((F.col("_n") >= HOT_ROWS) & (F.col("_n") * HOT_SHARE > F.col("_total")))
        .select(*[F.col(c).alias(f"_h_{c}") for c in on], F.lit(True).alias("_hot"))
    )

    def flagged(frame: DataFrame) -> DataFrame:
        match = F.lit(True)
        for c in on:
            match = match & (F.col(c) == F.col(f"_h_{c}"))
        return frame.join(hot, match, "left").drop(*[f"_h_{c}" for c in on])

    split = F.pmod(F.xxhash64(*spread_by), F.lit(ways)).cast("int")
    salted = flagged(facts).withColumn("_part", F.when(F.col("_hot"), split).otherwise(0)).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    copies = flagged(per_key).withColumn("_part", F.explode(parts)).drop("_hot")
    return salted.join(copies, [*on, "_part"], how).drop("_part")


def with_ordinal(
    frame: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str = "ordinal",
    partitions: int | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 without holding a group in one task.

    Rows are range-partitioned by (group, order), so a large group spans many
    partitions. Each partition numbers its rows; the counts of the partitions
    before it, at most one row per group and partition, give the offset.
    The order must be total. Range bounds are sampled, so the numbered frame is
    checkpointed before it is read twice.
    """
    keys = [F.col(g) for g in group] + list(order)
    width = partitions or shuffle_width(frame.sparkSession)
    placed = cut_lineage(
        frame.repartitionByRange(width, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id holds the partition number above bit 33
    placed = placed.withColumn("_piece", F.shiftright("_at", 33))
    pieces = placed.groupBy(*group, "_piece").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    if group:
        before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    else:
        before = Window.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(
            Window.unboundedPreceding, -1
        )
    offsets = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    renamed = offsets.select(*[F.col(c).alias(f"_k_{c}") for c in offsets.columns])
    match = F.col("_piece") == F.col("_k__piece")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    return (
        placed.join(renamed, match)
        .withColumn(name, F.col("_at") - F.col("_k__first") + F.col("_k__before") + 1)
        .select(*frame.columns, name)
    )


def first_n(
    frame: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread_by: Sequence[str],
    rank: str = "rank",
    ways: int | None = None,
) -> DataFrame:
    """The ``n`` first rows of each group: first within parts of the group, then overall."""
    ways = ways or shuffle_width(frame.sparkSession)
    part = F.pmod(F.xxhash64(*spread_by), F.lit(ways))
    inner = Window.partitionBy(*group, "_part").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    return (
        frame.withColumn("_part", part)
        .withColumn("_r", F.row_number().over(inner))
        .filter(F.col("_r") <= n)
        .drop("_part", "_r")
        .withColumn(rank, F.row_number().over(outer))
        .filter(F.col(rank) <= n)
    )


def latest(frame: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last version of every key; an aggregate, so versions combine before the shuffle."""
    rest = [c for c in frame.columns if c not in key]
    picked = frame.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*[F.col(k) if k in key else F.col(f"_row.{k}").alias(k) for k in frame.columns])


def listed(frame: DataFrame, key: Sequence[str], position: str, item: str) -> DataFrame:
    """Lists as rows (key, ordinal, item): the items of each key numbered from 1 in ``position`` order.

    ``position`` must tell the rows of a key apart. However long a list is, it has one form.
    """
    return with_ordinal(frame.select(*key, position, item), key, [F.col(position)]).select(*key, "ordinal", item)
