"""Exact nearest vectors by cosine, with cells that the triangle inequality rules out.

Vectors of unit length are grouped by their nearest of some centres, which are
fitted on a bounded sample; a cell knows its size and its radius, the distance of
its farthest member. No member of a cell is nearer to a query than the centre is,
less the radius, nor farther than the centre and the radius. A search scores the
cells next to each query first; the k-th score there rules out all cells that
cannot hold a better one. The order of cosines is that of distances, so results
are exact; on vectors without any clusters all cells are in reach.

Cells near each other make up groups of bounded size. A query is sent once to a
group with the list of its cells to score, so the copies of a vector are bounded by
the number of groups, and tasks work on bounded slices of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.blocks import DIGITS, dense_scorer, pair_blocks, slices
from logloom.session import cut_lineage

# Bounds of the centres: how many, numbers in all of them, rows of the sample for each
MOST_CELLS = 4096
MOST_NUMBERS = 1 << 20
SAMPLE_EACH = 16
ROUNDS = 5
MARGIN = 2e-6
# Members of a group of cells, and queries dealt to it at a time; a larger cell is a group, in several blocks
GROUP_ROWS = 8192


@dataclass(frozen=True)
class Cells:
    """``members`` (chunk_id, vector, cell, gap, group), and broadcast (names, centres, radii, sizes, groups) of the cells."""

    members: DataFrame
    shape: Broadcast


def unit(vectors: pd.Series):
    import numpy as np

    rows = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def sound(frame: DataFrame, key: str) -> DataFrame:
    """(key, vector): the rows whose vector has a direction."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col("vector")
    return frame.select(key, "vector").filter(F.coalesce(F.forall(v, number) & F.exists(v, lambda x: x != 0), F.lit(False)))


def centres_of(rows: DataFrame, most: int = MOST_CELLS):
    """Centres fitted by some rounds of spherical k-means on a sample drawn by hash, of about the root of the rows.

    The sample holds ``SAMPLE_EACH`` rows for each of ``most`` centres at most, and
    fewer where vectors are long, so its size is bounded.
    """
    import numpy as np

    n = rows.count()
    first = rows.select(F.size("vector")).first()
    if first is None:
        return np.zeros((0, 0))
    wanted = max(1, min(most, MOST_NUMBERS // max(1, first[0]), round(n**0.5)))
    place = F.pmod(F.xxhash64("chunk_id", F.lit("centre")), F.lit(1 << 30))
    # about twice the sample, whatever the number of rows, goes on to be ordered
    rate = min(1.0, 2 * SAMPLE_EACH * wanted / n)
    some = rows.filter(place < F.lit(int(rate * (1 << 30)))).orderBy(place, "chunk_id").limit(SAMPLE_EACH * wanted)
    sample = unit(pd.Series([r.vector for r in some.select("vector").collect()])) if n else None
    centres = np.unique(sample[:wanted], axis=0)
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
    return centres


def build(chunks: DataFrame, most: int = MOST_CELLS) -> Cells:
    """Cells of (chunk_id, vector); rows whose vector has no direction are in none."""
    rows = sound(chunks, "chunk_id")
    context = chunks.sparkSession.sparkContext
    centres = context.broadcast(centres_of(rows, most))
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    vector = chunks.schema["vector"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            if len(batch):
                near = unit(batch["vector"]) @ centres.value.T
                own = near.argmax(axis=1)
                yield batch.assign(cell=own, gap=np.sqrt(np.maximum(0.0, 2 - 2 * near[np.arange(len(own)), own])))

    members = cut_lineage(rows.mapInPandas(assign, f"chunk_id {kind}, vector {vector}, cell int, gap double"))
    shape = _shape(members, centres.value)
    # a row per cell, MOST_CELLS at most
    own = chunks.sparkSession.createDataFrame([(int(c), int(g)) for c, g in zip(shape[0], shape[4])], "cell int, group int")
    return Cells(members.join(F.broadcast(own), "cell"), context.broadcast(shape))


def _shape(members: DataFrame, centres):
    """(names, centres, radii, sizes, groups): a row per cell reaches the driver, ``MOST_CELLS`` at most."""
    import numpy as np

    radius, size = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    for r in members.groupBy("cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        # a little more than measured: rounding must not rule out a cell
        radius[r.cell], size[r.cell] = r.radius + 1e-7, r.n
    held = size > 0
    names, centres, radius, size = np.flatnonzero(held), centres[held], radius[held], size[held]
    return names, centres, radius, size, groups_of(centres, size)


def groups_of(centres, size):
    """The group of every cell: cells next to the same of a few centres follow each other and fill a group."""
    import numpy as np

    group = np.zeros(len(size), dtype=np.int64)
    if not len(size):
        return group
    few = max(1, int(size.sum()) // GROUP_ROWS)
    order = np.argsort((centres @ centres[:few].T).argmax(axis=1), kind="stable")
    at, held = 0, 0
    for cell in order:
        if held and held + size[cell] > GROUP_ROWS:
            at, held = at + 1, 0
        group[cell] = at
        held += size[cell]
    return group


def _distances(vectors: pd.Series, centres):
    import numpy as np

    return np.sqrt(np.maximum(0.0, 2 - 2 * (unit(vectors) @ centres.T)))


def _score(distance):
    """The cosine at a distance of unit vectors, which are no farther apart than 2."""
    import numpy as np

    distance = np.clip(distance, 0.0, 2.0)
    return 1 - distance * distance / 2


def visits(queries: DataFrame, cells: Cells, k: int, floors: DataFrame | None = None) -> DataFrame:
    """(query_id, vector, group, cells): the cells to score for each query (query_id, vector), those of a group together.

    Without ``floors`` the nearest cells that hold ``k`` members together; with
    ``floors`` (query_id, floor) all others that may hold a score of the floor.
    """
    shape = cells.shape
    rows = sound(queries, "query_id")
    beyond = floors is not None
    if beyond:
        rows = rows.join(floors, "query_id", "left")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        names, centres, radius, size, group = shape.value
        # cells in the order of their groups, and where each group begins
        order_of = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[order_of], prepend=-1))
        for batch in batches:
            if not len(batch) or not len(names):
                continue
            for _, some in slices(batch, len(names) + len(starts) * len(batch["vector"].iloc[0])):
                gaps = _distances(some["vector"], centres)
                order = np.argsort(gaps, axis=1, kind="stable")
                held = np.cumsum(size[order], axis=1)
                nearest = np.zeros(gaps.shape, dtype=bool)
                np.put_along_axis(nearest, order, held - size[order] < k, axis=1)
                wanted = nearest
                if beyond:
                    floor = some["floor"].to_numpy(dtype=float)[:, None]
                    wanted = ~nearest & (np.isnan(floor) | (_score(gaps - radius) >= floor - MARGIN))
                wanted = wanted[:, order_of]
                at, piece = np.nonzero(np.logical_or.reduceat(wanted, starts, axis=1))
                ends = np.append(starts[1:], len(names))
                lists = [
                    names[order_of[starts[g] : ends[g]][wanted[i, starts[g] : ends[g]]]].astype(np.int32) for i, g in zip(at, piece)
                ]
                yield some[["query_id", "vector"]].iloc[at].assign(group=group[order_of[starts[piece]]], cells=pd.Series(lists, index=some.index[at], dtype=object))

    kind, vector = (queries.schema[c].dataType.simpleString() for c in ("query_id", "vector"))
    return rows.mapInPandas(choose, f"query_id {kind}, vector {vector}, group int, cells array<int>")


def _with_blocks(asked: DataFrame, cells: Cells) -> tuple[DataFrame, DataFrame, tuple]:
    """Both sides with the numbers of blocks of every group: a crowded one, or one many queries visit, is dealt out."""
    of = lambda frame, name: frame.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias(name))
    # a row per group, MOST_CELLS at most
    sizes = F.broadcast(cut_lineage(of(asked, "_nl").join(of(cells.members, "_nr"), "group")))
    return asked.join(sizes, "group"), cells.members.drop("gap").join(sizes, "group"), (F.col("_nl"), F.col("_nr"))


def _scored(asked: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, chunk_id, score): the ``k`` best of each visited block of a group, of the cells asked for."""
    left, right, blocks = _with_blocks(cut_lineage(asked), cells)
    kind = {f.name: f.dataType.simpleString() for f in [*left.schema.fields, *right.schema.fields]}
    score = dense_scorer("cosine")

    def visit(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        r = r.sort_values("chunk_id", kind="stable").reset_index(drop=True)
        ids, own = r["chunk_id"].to_numpy(), r["cell"].to_numpy()
        there = np.unique(own)
        all_cells = len(there)
        parts = []
        for _, some in slices(l, len(r)):
            near = np.round(score(some, r), DIGITS)
            for i, wanted in enumerate(some["cells"]):
                row = -near[i]
                if len(wanted) < all_cells or not np.isin(there, wanted).all():
                    row[~np.isin(own, wanted)] = np.inf
                picked = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if k < len(row) else np.arange(len(row))
                picked = picked[np.isfinite(row[picked])]
                picked = picked[np.argsort(row[picked], kind="stable")][:k]
                if len(picked):
                    parts.append((some["query_id"].iloc[i], ids[picked], -row[picked]))
        return pd.DataFrame(
            {
                "query_id": [q for q, found, _ in parts for _ in found],
                "chunk_id": np.concatenate([found for _, found, _ in parts]) if parts else [],
                "score": np.concatenate([s for _, _, s in parts]) if parts else [],
            }
        )

    return pair_blocks(
        left, right, "query_id", "chunk_id", ["group"], visit, f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, score double", blocks
    )


def best(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` members of greatest cosine of every query (query_id, vector).

    Scores are rounded; equal scores rank by the chunk. Vectors without a direction match nothing.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("chunk_id"))
    first = cut_lineage(_scored(visits(queries, cells, k), cells, k).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k))
    floor = first.filter(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
    rest = _scored(visits(queries, cells, k, floor), cells, k)
    both = first.drop("r").unionByName(rest)
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def scored_pairs(queries: DataFrame, cells: Cells, k: int, found: DataFrame) -> int:
    """How many pairs a search for ``k`` scored that gave ``found``, for measuring."""
    floor = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    sizes = cells.members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    asked = visits(queries, cells, k).unionByName(visits(queries, cells, k, floor)).select(F.explode("cells").alias("cell"))
    return asked.join(F.broadcast(sizes), "cell").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def ranks_of(wanted: DataFrame, queries: DataFrame, cells: Cells) -> DataFrame:
    """(query_id, chunk_id, rank) of the ``wanted`` pairs in the full ranking of each query; rows without a direction have none.

    ``wanted`` holds a bounded number of chunks per query; the pairs are scored by
    themselves. Cells that lie wholly before or behind a score are counted whole,
    the others' members are compared.
    """
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *cells.members.schema.fields]}
    pair = f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}"
    score = dense_scorer("cosine")
    beside = (
        wanted.select("query_id", "chunk_id")
        .join(sound(queries, "query_id").withColumnRenamed("vector", "own"), "query_id")
        .join(cells.members.select("chunk_id", "vector"), "chunk_id")
    )

    def score_wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for rows in batches:
            if len(rows):
                own = pd.DataFrame({"vector": rows["own"]})
                yield rows[["query_id", "chunk_id"]].assign(score=np.round(score.pairs(own, rows), DIGITS))

    scored = cut_lineage(beside.mapInPandas(score_wanted, f"{pair}, score double"))
    targets = cut_lineage(
        scored.groupBy("query_id").agg(F.collect_list("chunk_id").alias("ids"), F.collect_list("score").alias("scores")).join(
            queries.select("query_id", "vector"), "query_id"
        )
    )
    shape = cells.shape

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        names, centres, radius, size, group = shape.value
        for batch in batches:
            if not len(batch) or not len(names):
                continue
            for _, some in slices(batch, len(names) + (int(group.max()) + 1) * len(batch["vector"].iloc[0])):
                gaps = _distances(some["vector"], centres)
                most, least = _score(gaps - radius) + MARGIN, _score(gaps + radius) - MARGIN
                out = []
                for i, (query, vector, ids, scores) in enumerate(zip(some["query_id"], some["vector"], some["ids"], some["scores"])):
                    ids, s = np.asarray(ids, dtype=object), np.asarray(scores, dtype=float)[:, None]
                    before, behind = least[i] > s, most[i] < s
                    whole = np.zeros(len(ids), dtype=np.int64)
                    for g in np.unique(group):
                        inside = group == g
                        # a group some cell of which lies around a score is compared, member by member
                        open_ = (~before[:, inside] & ~behind[:, inside]).any(axis=1)
                        whole += np.where(open_, 0, before[:, inside] @ size[inside])
                        if open_.any():
                            out.append((query, vector, int(g), ids[open_], s[open_, 0], None))
                    out.append((query, None, -1, ids, scores, whole))
                yield pd.DataFrame(out, columns=["query_id", "vector", "group", "ids", "scores", "whole"])

    shape_of = f"query_id {kind['query_id']}, vector {queries.schema['vector'].dataType.simpleString()}, group int, ids array<{kind['chunk_id']}>, scores array<double>, whole array<bigint>"
    chosen = cut_lineage(targets.mapInPandas(choose, shape_of))
    whole = chosen.filter("group < 0").select("query_id", F.explode(F.arrays_zip("ids", "whole")).alias("w")).select(
        "query_id", F.col("w.ids").alias("chunk_id"), F.col("w.whole").alias("n")
    )

    def count_before(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        names, rows = r["chunk_id"].to_numpy(), []
        for _, some in slices(l, len(r)):
            near = np.round(score(some, r), DIGITS)
            for i, (owner, ids, scores) in enumerate(zip(some["query_id"], some["ids"], some["scores"])):
                for w, s in zip(ids, scores):
                    rows.append((owner, w, int(((near[i] > s) | ((near[i] == s) & (names < w))).sum())))
        return pd.DataFrame(rows, columns=["query_id", "chunk_id", "n"])

    left, right, blocks = _with_blocks(chosen.filter("group >= 0").drop("whole"), cells)
    counted = pair_blocks(left, right, "query_id", "chunk_id", ["group"], count_before, f"{pair}, n bigint", blocks)
    return whole.unionByName(counted).groupBy("query_id", "chunk_id").agg((F.sum("n") + 1).alias("rank"))
