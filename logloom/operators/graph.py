"""Iterative graph operators on edge frames, each round checkpointed.

Many edges may meet in one node. Minima per node are aggregates, combined before
their shuffle; the joins that hand them back to the edges split the nodes that
hold many edges. Edges of a counted, small number are joined up in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.spread import lookup_large
from logloom.session import cut_lineage

# Edges up to which one task finds all components, in memory that this bounds
LOCAL_EDGES = 400_000


def _rounds(nodes: int) -> int:
    """More rounds than loops over ``nodes`` nodes that halve distances can take."""
    return 2 * max(1, nodes).bit_length() + 8


def ancestor_chains(links: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """Where the chain of parents of every node ends, by pointer doubling.

    ``links`` has one row per node; the parent is null at a root. Returns
    (node, parent, end, last, hops, low): ``end`` is ``root``, ``missing`` (the
    chain leaves the nodes) or ``cycle``; ``last`` the node it ends in; ``hops``
    its length. On and before a cycle ``last`` is some node of the cycle and
    ``low`` the least node passed, so all members of a cycle share ``low``.

    Every round doubles the distance looked back, so rounds grow with the
    logarithm of the depth.
    """
    state = links.select(
        F.col(node).alias("node"),
        F.col(parent).alias("parent"),
        F.col(parent).alias("at"),
        F.when(F.col(parent).isNull(), F.lit("root")).alias("end"),
        F.when(F.col(parent).isNull(), F.col(node)).alias("last"),
        F.when(F.col(parent).isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
        F.col(parent).alias("low"),
        F.lit(True).alias("moved"),
    )
    state = cut_lineage(state)
    before = None
    most = _rounds(state.count())
    for _ in range(most):
        seen = state.filter("end is null").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("moved"), 1)).alias("moved")
        ).first()
        if seen.n == 0:
            break
        if before is not None and seen.n == before[0]:
            # only nodes on or before a cycle are left; done when all landings are on it
            landings = state.filter("end is null").select("at").distinct().count()
            if landings == before[1] and seen.moved == 0:
                break
            before = (seen.n, landings)
        else:
            before = (seen.n, -1)
        other = state.select(
            F.col("node").alias("at"),
            F.col("at").alias("_at"),
            F.col("end").alias("_end"),
            F.col("last").alias("_last"),
            F.col("hops").alias("_hops"),
            F.col("low").alias("_low"),
            F.lit(True).alias("_found"),
        )
        moving = state.filter("end is null").join(other, ["at"], "left")
        lost = F.col("_found").isNull()
        low = F.least("low", "_low")
        moved = moving.select(
            "node",
            "parent",
            F.when(~lost & F.col("_end").isNull(), F.col("_at")).alias("at"),
            F.when(lost, F.lit("missing")).otherwise(F.col("_end")).alias("end"),
            F.when(lost, F.col("at")).otherwise(F.col("_last")).alias("last"),
            F.when(lost, F.col("hops")).otherwise(F.col("hops") + F.col("_hops")).alias("hops"),
            F.coalesce(low, F.col("low")).alias("low"),
            (F.coalesce(low, F.col("low")) != F.col("low")).alias("moved"),
        )
        state = cut_lineage(state.filter("end is not null").unionByName(moved))
    else:
        raise RuntimeError(f"chains did not settle in {most} rounds")
    return state.select(
        "node",
        "parent",
        F.coalesce("end", F.lit("cycle")).alias("end"),
        F.coalesce("last", "at").alias("last"),
        "hops",
        "low",
    )


def cycle_members(chains: DataFrame) -> DataFrame:
    """(cycle_id, node, parent): the nodes on cycles; a cycle is named by its least node."""
    looping = chains.filter(F.col("end") == "cycle")
    on_cycle = looping.select(F.col("last").alias("node")).distinct()
    return looping.join(on_cycle, ["node"], "left_semi").select(
        F.col("low").alias("cycle_id"), "node", "parent"
    )


def connected_components(nodes: DataFrame, edges: DataFrame, local: int | None = None) -> DataFrame:
    """(node, component): component is the least node reachable. ``edges`` are (a, b).

    Up to ``local`` distinct edges (``LOCAL_EDGES`` by default) one task suffices;
    their number is counted first. More are worked off by alternating large-star
    and small-star steps, which shrink every component to a star in
    logarithmically many rounds.
    """
    stars = cut_lineage(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
        .distinct()
    )
    mark = _signature(stars)
    if mark[0] <= (LOCAL_EDGES if local is None else local):
        stars = cut_lineage(_joined_up(stars))
    else:
        stars = _starred(stars, mark)
    return nodes.join(stars.select(F.col("v").alias("node"), "m"), ["node"], "left").select(
        "node", F.coalesce("m", "node").alias("component")
    )


def _starred(stars: DataFrame, mark) -> DataFrame:
    most = _rounds(mark[0])
    for _ in range(most):
        stars = cut_lineage(_small_star(_large_star(stars)))
        now = _signature(stars)
        if now == mark:
            return stars
        mark = now
    raise RuntimeError(f"components did not settle in {most} rounds")


def _joined_up(stars: DataFrame) -> DataFrame:
    """The stars of all components, by union-find over arrays in one task: for few edges only."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        v, m = (rows.column(c).combine_chunks() for c in ("v", "m"))
        # nodes by number, in the order of their values: numbers, text and bytes sort as Spark sorts them
        known = pc.unique(pa.concat_arrays([v, m]))
        known = known.take(pc.sort_indices(known))
        a, b = (pc.index_in(c, known).to_numpy() for c in (v, m))
        label = np.arange(len(known))
        while True:
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            if (low == high).all():
                break
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
        at = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_pydict({"v": known.take(pa.array(at)), "m": known.take(pa.array(label[at]))})

    kind = stars.schema["v"].dataType.simpleString()
    return stars.coalesce(1).mapInArrow(of, f"v {kind}, m {kind}")


def _signature(stars: DataFrame):
    return tuple(
        stars.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))
        ).first()
    )


def _large_star(stars: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbourhood."""
    both = stars.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(
        stars.select(F.col("m").alias("u"), F.col("v").alias("w"))
    )
    least = both.groupBy("u").agg(F.min("w").alias("_w")).select(
        "u", F.least("u", "_w").alias("least")
    )
    larger = both.filter(F.col("w") > F.col("u"))
    return (
        lookup_large(larger, least, ["u"], ["w"], how="inner")
        .select(F.col("w").alias("v"), F.col("least").alias("m"))
        .distinct()
    )


def _small_star(stars: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = stars.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("w"))
    least = down.groupBy("u").agg(F.min("w").alias("least"))
    joined = lookup_large(down, least, ["u"], ["w"], how="inner")
    return (
        joined.filter("w <> least")
        .select(F.col("w").alias("v"), F.col("least").alias("m"))
        .unionByName(least.select(F.col("u").alias("v"), F.col("least").alias("m")))
        .distinct()
    )
