"""SimHash fingerprints and the groups that a few differing bits link.

Candidates: 64 bits are cut into blocks; two fingerprints that differ in at most
``bits`` places agree on all but ``bits`` of the blocks, so each choice of the
other blocks is a hash table in which every linked pair meets. Distances to a
pivot concentrate at 32 +- 4 for any data that is not one cluster, so a window
of +-4 on them selects too little to deal rows out by; pivots filter inside the
buckets: a table of Hamming distances to many reference fingerprints is computed
once per fingerprint, pairs with a coordinate that differs by more than ``bits``
are discarded, survivors are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.spread import lookup_large
from logloom.llm.common import group_starts, roots, splitmix, whole_groups
from logloom.operators.graph import connected_components
from logloom.session import cut_lineage

SEED = 42
PIVOTS = 24
# Rows of a bucket that one task compares with each other; larger buckets are tiled
TILE = 512
# Expected rows per bucket from which more blocks are used
BUCKET = 256
# Shingles whose bits are unpacked at a time
SLICE = 1 << 16
# Linked pairs held before they are reduced to a forest
HELD = 1 << 21


def simhash(text: str | None, width: int, seed: int = SEED) -> int:
    """The fingerprint of one text: a bit is 1 if set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :][:n]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n
    )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLICE):
        rows = hashes[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: Column, width: int = 4) -> Column:
    """The fingerprint as a signed long. Null and wordless texts give 0."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            marks = np.fromiter((simhash(t, width) for t in part), np.uint64, len(part))
            yield pd.Series(marks.view(np.int64))

    return of(text)


def as_hex(mark: Column) -> Column:
    return F.lower(F.lpad(F.hex(mark), 16, "0"))


def block_masks(blocks: int, bits: int) -> list[int]:
    """One mask per choice of ``blocks - bits`` blocks, as signed longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    spans = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(spans, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(rows: int, bits: int) -> int:
    """The fewest blocks whose buckets hold ``BUCKET`` rows of ``rows`` at most, if spread evenly."""
    blocks = bits + 1
    while blocks < bits + 6 and rows >> (64 * (blocks - bits) // blocks) > BUCKET:
        blocks += 1
    return blocks


def pairs_within(marks: np.ndarray, ends: np.ndarray, side: np.ndarray, cross: np.ndarray, bits: int, pivots: np.ndarray):
    """Index pairs i < j < ends[i] at most ``bits`` apart; where ``cross[i]``, only of different sides."""
    table = np.bitwise_count(marks[:, None] ^ pivots[None, :]).astype(np.int8)
    left = np.arange(len(marks))
    gap = 0
    while True:
        gap += 1
        left = left[ends[left] > left + gap]
        if not len(left):
            return
        i = left[~cross[left] | (side[left] != side[left + gap])]
        for p in range(0, len(pivots), 4):
            near = np.abs(table[i, p : p + 4] - table[i + gap, p : p + 4]).max(axis=1) <= bits
            i = i[near]
            if not len(i):
                break
        i = i[np.bitwise_count(marks[i] ^ marks[i + gap]) <= bits]
        if len(i):
            yield i, i + gap


def link(marks: DataFrame, bits: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints in column ``fp``: a spanning forest per tile.

    The links connect the same fingerprints as all pairs at most ``bits`` apart do.
    """
    spark = marks.sparkSession
    masks = block_masks(blocks_for(marks.count(), bits), bits)
    keys = marks.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
        ).alias("key"),
    ).select("fp", "key.t", "key.k")
    crowded = keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE)
    tiles = F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int")
    tiled = (
        keys.join(crowded, ["t", "k"], "left")
        .withColumn("side", F.pmod(F.xxhash64("fp"), tiles).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select("t", "k", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "fp")
    )
    group = ["t", "k", "lo", "hi"]
    pivots = splitmix(PIVOTS, SEED)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, group):
            starts = group_starts(rows, group)
            sizes = np.diff(np.append(starts, rows.num_rows))
            ends = np.repeat(starts + sizes, sizes)
            own = rows.column("fp").to_numpy()
            lo, hi, side = (rows.column(c).to_numpy() for c in ("lo", "hi", "side"))
            label, held, n_held = np.arange(len(own)), [], 0
            for pair in pairs_within(own.view(np.uint64), ends, side, lo != hi, bits, pivots):
                held.append(pair)
                n_held += len(pair[0])
                if n_held > HELD:
                    label = joined(label, held)
                    held, n_held = [], 0
            label = joined(label, held)
            linked = np.flatnonzero(label != np.arange(len(own)))
            yield pa.RecordBatch.from_pydict({"a": own[linked], "b": own[label[linked]]})

    def joined(label: np.ndarray, held: list) -> np.ndarray:
        a = np.concatenate([np.arange(len(label)), *(p[0] for p in held)])
        b = np.concatenate([label, *(p[1] for p in held)])
        return roots(len(label), a, b)

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        tiled.repartition(width, *group)
        .sortWithinPartitions(*group)
        .mapInArrow(compare, "a long, b long")
        .distinct()
    )


def near_groups(
    docs: DataFrame, width: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """(id, fp, component_id) per row of ``docs``; with a ``row_col`` also that column and ``group_fp``.

    Rows whose fingerprints a chain of links of at most ``bits`` differing bits
    joins are one component, named by its smallest id; null ids are passed over
    in that choice. Wordless and null texts share fingerprint 0. Rows of one
    fingerprint are compared once. Other columns are not read. ``group_fp`` is a
    fingerprint of the component, which tells components apart also where ids repeat.
    """
    rows = [row_col] if row_col else []
    marked = cut_lineage(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("fp"), *rows))
    marks = cut_lineage(marked.groupBy("fp").agg(F.min("id").alias("first")))
    links = cut_lineage(link(marks.select("fp"), bits))
    linked = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    members = connected_components(linked, links).withColumnRenamed("node", "fp")
    names = (
        members.join(marks, "fp").groupBy("component").agg(F.min("first").alias("name"))
    )
    named = lookup_large(members, names, ["component"], ["fp"], how="inner").select("fp", "name", "component")
    per_mark = marks.join(named, "fp", "left").select(
        "fp", F.coalesce("name", "first").alias("component_id"), F.coalesce("component", "fp").alias("group_fp")
    )
    # copies and wordless texts may share one fingerprint by the third of all rows
    named = lookup_large(marked, per_mark, ["fp"], ["id", *rows], how="inner")
    return named.select("id", "fp", "component_id", *([*rows, "group_fp"] if rows else []))
