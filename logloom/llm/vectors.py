"""Embedding near-duplicates by sorted projection passes.

Each pass hashes every vector to the signs of random projections, concatenated
into one number, sorts by it and numbers the rows; tiles of ``window`` rows are
compared with themselves and the next tile, so every pair up to ``window`` places
apart is verified.

Cells are vectors of equal first signs. One larger than a window is compared
whole: all its tiles, each pair of tiles in a group of its own. So two vectors
that share the first b signs in some pass are always compared, which a pass does
for a pair at the threshold with probability (1 - angle / pi) ** b, whatever the
other vectors are. The number of passes follows from that and the recall asked
for; which b is cheapest follows from the cells of a few passes, measured over
the whole table. A pair that meets in several passes counts in the first of
them, which each side can tell from the places both have in earlier passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.spread import lookup_large, with_ordinal
from logloom.llm.common import group_starts, roots, whole_groups
from logloom.operators.graph import connected_components
from logloom.session import cut_lineage, shuffle_width

WINDOW = 512
RECALL = 0.98
SIGNS = 62
# Passes whose cells are measured before the plan is made
PROBES = 2
# What a row costs in a pass beside comparisons, and a copy of it for a dense cell, in comparisons
PASS_COST = 400
COPY_COST = 300
SEED = 7


def passes_at(signs: int, threshold: float, recall: float) -> int:
    """Passes after which a pair at the threshold has shared the first ``signs`` in one with probability ``recall``."""
    together = (1 - math.acos(threshold) / math.pi) ** signs
    return 1 if together >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-together)))


def cheapest(crowd: dict[int, float], rows: int, threshold: float, window: int, recall: float) -> tuple[int, int]:
    """(passes, signs) of least cost. ``crowd`` has for numbers of signs how many rows the cell of a row holds on average."""

    def cost(signs: int) -> float:
        beyond = max(0.0, crowd[signs] - 2 * window)
        return passes_at(signs, threshold, recall) * (PASS_COST + 1.5 * min(window, rows) + beyond / 2 + beyond / window * COPY_COST)

    signs = min(crowd, key=lambda s: (cost(s), s))
    return passes_at(signs, threshold, recall), signs


def signs_tried(rows: int, window: int) -> list[int]:
    even = max(0, math.ceil(math.log2(max(1, rows) / window)))
    return [s for s in range(SIGNS + 1) if s == 0 or even - 2 <= s <= even + 12]


def passes_for(rows: int, threshold: float, window: int, recall: float) -> tuple[int, int]:
    """(passes, signs) for evenly spread vectors."""
    return cheapest({s: max(1.0, rows / 2**s) for s in signs_tried(rows, window)}, rows, threshold, window, recall)


def plan(distinct: DataFrame, threshold: float, window: int, recall: float, kind: str) -> tuple[int, int]:
    """(passes, first signs of a cell), from the cells that ``PROBES`` passes make of all vectors."""
    rows = distinct.count()
    tried = signs_tried(rows, window)
    keys = with_keys(distinct, PROBES, kind)
    cells = keys.select(
        "pass", "dim", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.shiftright("key", SIGNS - s).alias("cell")) for s in tried])).alias("c")
    )
    sizes = cells.groupBy("pass", "dim", "c").agg(F.count(F.lit(1)).cast("double").alias("n"))
    crowd = sizes.groupBy("c.s").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).collect()
    return cheapest({r.s: r.pairs / (PROBES * rows) for r in crowd}, rows, threshold, window, recall) if crowd else (1, 0)


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of unit length in double precision, scaled first so that no square overflows."""
    rows = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vector_col: str, kind: str) -> DataFrame:
    """(id, mark, dim, raw): the vectors that can link, as bytes and a digest of them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, raws = [], [], []
            column = batch.column(1)
            for i, values in zip(batch.column(0).to_pylist(), column):
                if not values.is_valid or values.values.null_count or not len(values):
                    continue
                row = values.values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(row).all() and row.any():
                    ids.append(i)
                    dims.append(len(row))
                    raws.append((row + 0.0).tobytes())
            yield pa.RecordBatch.from_pydict(
                {"id": ids, "dim": dims, "raw": raws},
                schema=pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("raw", pa.binary())]),
            )

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(of, "id long, dim int, raw binary").withColumn("mark", F.unhex(F.sha1("raw")))


def with_keys(distinct: DataFrame, passes: int, kind: str) -> DataFrame:
    """(mark, dim, pass, key): the concatenated signs of each pass."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            marks, dims, raws = (batch.column(c).to_pylist() for c in range(3))
            for dim in set(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, SIGNS * passes))
                at = [i for i, d in enumerate(dims) if d == dim]
                signs = unit([raws[i] for i in at], kind) @ planes[dim] > 0
                keys = signs.reshape(len(at), passes, SIGNS) @ powers
                yield pa.RecordBatch.from_pydict(
                    {
                        "mark": pa.array([marks[i] for i in at for _ in range(passes)], pa.binary()),
                        "dim": pa.array(np.full(len(at) * passes, dim), pa.int32()),
                        "pass": pa.array(np.tile(np.arange(passes), len(at)), pa.int32()),
                        "key": pa.array(keys.ravel(), pa.int64()),
                    }
                )

    return distinct.select("mark", "dim", "raw").mapInArrow(of, "mark binary, dim int, pass int, key long")


def placed(distinct: DataFrame, passes: int, signs: int, window: int, kind: str) -> DataFrame:
    """Distinct vectors with arrays of their tile and cell in every pass."""
    ranked = with_ordinal(with_keys(distinct, passes, kind), ["pass", "dim"], [F.col("key"), F.col("mark")], name="rank")
    spots = ranked.select(
        "mark",
        F.struct(
            "pass",
            ((F.col("rank") - 1) / window).cast("bigint").alias("tile"),
            F.shiftright("key", SIGNS - signs).alias("cell"),
        ).alias("spot"),
    )
    spots = spots.groupBy("mark").agg(F.array_sort(F.collect_list("spot")).alias("spots"))
    return distinct.join(spots, "mark").select(
        "mark", "dim", "raw", "copies", F.col("spots.tile").alias("tiles"), F.col("spots.cell").alias("cells")
    )


def tasks(rows: DataFrame, passes: int) -> DataFrame:
    """Rows copied to the groups that compare them: (pass, cell, lo, hi, side) and the row.

    ``cell`` is -1 where a tile ``lo`` is compared with itself and the next, else
    two tiles of one dense cell are compared.
    """
    each = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    tile, cell = F.element_at("tiles", F.col("pass") + 1), F.element_at("cells", F.col("pass") + 1)
    each = each.withColumn("tile", tile).withColumn("in_cell", cell)
    windows = each.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *rows.columns, "pass", F.lit(-1).cast("bigint").alias("cell"), (F.col("tile") - F.col("s")).alias("lo"), (F.col("tile") - F.col("s") + 1).alias("hi"), F.col("s").alias("side")
    )
    dense = (
        each.groupBy("dim", "pass", "in_cell")
        .agg(F.min("tile").alias("first"), F.max("tile").alias("last"))
        .filter(F.col("last") - F.col("first") > 1)
    )
    crowded = each.join(dense, ["dim", "pass", "in_cell"]).withColumn("other", F.explode(F.sequence("first", "last")))
    crowded = crowded.filter(F.abs(F.col("other") - F.col("tile")) > 1).select(
        *rows.columns, "pass", F.col("in_cell").alias("cell"), F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), (F.col("tile") > F.col("other")).cast("int").alias("side")
    )
    return windows.unionByName(crowded)


def verified(rows: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(a, n, b): per group and vector, how many vectors it links with that it met in no earlier
    pass, and the least vector of its component there."""
    group = ["pass", "dim", "cell", "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, group):
            starts = np.append(group_starts(part, group), part.num_rows)
            for first, last in zip(starts[:-1], starts[1:]):
                if last - first > 1:
                    found = links(part.slice(first, last - first))
                    if found:
                        yield found

    def links(rows: pa.Table) -> pa.RecordBatch | None:
        step, cell = rows.column("pass")[0].as_py(), rows.column("cell")[0].as_py()
        side = rows.column("side").to_numpy()
        vectors = unit(rows.column("raw").to_pylist(), kind)
        near = vectors[side == 0] @ vectors.T >= threshold
        own = np.flatnonzero(side == 0)
        i, j = np.nonzero(near)
        i = own[i]
        # within the lower tile each pair once; tiles of a dense cell only across
        keep = (side[j] == 1) | ((i < j) if cell < 0 else False)
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        copies = rows.column("copies").to_numpy()
        new = np.ones(len(i), dtype=bool)
        if step:
            tiles, cells = (
                np.array(rows.column(c).combine_chunks().flatten().to_numpy()).reshape(rows.num_rows, -1)[:, :step] for c in ("tiles", "cells")
            )
            met = (np.abs(tiles[i] - tiles[j]) <= 1) | (cells[i] == cells[j])
            new = ~met.any(axis=1)
        i, j = i[new], j[new]
        n = np.bincount(i, weights=copies[j], minlength=len(side)) + np.bincount(j, weights=copies[i], minlength=len(side))
        label = roots(len(side), i, j)
        at = np.flatnonzero(n)
        marks = rows.column("mark").combine_chunks()
        return pa.RecordBatch.from_pydict(
            {"a": marks.take(at), "n": pa.array(n[at].astype(np.int64)), "b": marks.take(label[at])}
        )

    return (
        rows.repartition(shuffle_width(rows.sparkSession), *group)
        .sortWithinPartitions(*group)
        .mapInArrow(compare, "a binary, n long, b binary")
    )


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.9,
    window: int = WINDOW,
    recall: float = RECALL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id) per row of ``vectors``.

    Links are pairs of rows with cosine of at least ``threshold``, found with the
    expected ``recall`` at the threshold and more above it; equal vectors link
    always, and are compared with others once. Null, empty and zero vectors and
    those with a null or non-finite component link with nothing, nor do vectors of
    different lengths. A component is named by its smallest id; a row without an
    id gives no name, and one that links with nothing is its own component.
    """
    kind = "f8" if vectors.schema[vector_col].dataType.elementType == T.DoubleType() else "f4"
    rows = cut_lineage(usable(vectors, id_col, vector_col, kind))
    distinct = cut_lineage(
        rows.groupBy("mark", "dim", "raw").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    )
    passes, signs = plan(distinct, threshold, window, recall, kind)
    spots = cut_lineage(placed(distinct, passes, signs, window, kind))
    found = cut_lineage(verified(tasks(spots, passes), threshold, kind))
    n_links = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "mark")
    edges = found.filter("a <> b").select("a", "b").distinct()
    linked = found.select(F.col("a").alias("node")).distinct()
    members = connected_components(linked, edges).withColumnRenamed("node", "mark")
    names = members.join(distinct, "mark").groupBy("component").agg(F.min("first").alias("name"))
    named = lookup_large(members, names, ["component"], ["mark"], how="inner").select("mark", "name")
    per_mark = (
        distinct.select("mark", "first", "copies")
        .join(n_links, "mark", "left")
        .join(named, "mark", "left")
        .select("mark", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "first").alias("component_id"))
    )
    linking = lookup_large(rows.select("id", "mark"), per_mark, ["mark"], ["id"], how="inner").select("id", "n_links", "component_id")
    return linking.unionByName(alone(vectors, id_col, vector_col))


def alone(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The rows that can link with nothing."""
    v = F.col(vector_col)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    sound = F.coalesce(
        F.forall(v, number) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False)
    )
    own = F.col(id_col).cast("bigint")
    return vectors.filter(~sound).select(own.alias("id"), F.lit(0).cast("bigint").alias("n_links"), own.alias("component_id"))
