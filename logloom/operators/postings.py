"""Exact weighted token search over an inverted index.

Postings are rows (token, run, chunk, weight). Chunks are dealt into runs by a
hash; per token and run the least and greatest weight are kept, and per token
over all. A query's score of a chunk is the sum of its token weights times the
chunk's.

A search first scores a few runs in which the query's strongest tokens are
strong; the k-th score there is a floor of the result. Tokens that all together
stay below the floor cannot bring a chunk into the result, so only chunks that
hold one of the others, the deciding tokens, are looked at; runs whose greatest
weights stay below the floor are skipped, and of the chunks met only those that
may still reach the floor are given the rest of their sum. What is read of the
postings follows the matches, and nothing is approximated. Postings of a token
that many chunks hold are spread by run.

Where few queries are asked, the tokens of each chunk are read once instead, as one row:
a task scores a slice of chunks against all queries and passes on its best, or how many
chunks it placed before some, so no match is shuffled. Many queries that differ only
in tokens few chunks hold ask for the same common tokens: these are searched once
for all of them, and the few chunks with a rare token are scored in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.spread import first_n, lookup_large
from logloom.session import cut_lineage

# Chunks of a run, and runs at most: bounds what a query token meets before any posting is read
RUN_CHUNKS = 128
MOST_RUNS = 1024
# Strongest tokens by whose runs a first few are chosen, and those
FIRST_TOKENS = 3
FIRST_RUNS = 2
# Queries, and tokens of them, that are broadcast to one reading of the postings; scores and matches that a task holds then
SCAN_QUERIES = 1024
SCAN_TOKENS = 1 << 17
SCAN_CELLS = 1 << 22
# Chunks that hold a rare token at most
RARE_CHUNKS = 64
# Digits kept of a score: makes order and ties independent of the order of summation
DIGITS = 6
# Scores that differ by less are equal to the digits kept, up to rounding
MARGIN = 2e-6


@dataclass(frozen=True)
class Index:
    """``postings`` (token, run, chunk_id, weight), ``tops`` (token, run, low, high, held) and ``limits`` (token, low, high, held),
    and ``lists`` (chunk_id, tokens, weights), a row per chunk; each is made when it is asked for."""

    given: DataFrame
    run_chunks: int
    most_runs: int
    by_chunk: DataFrame | None = None

    @cached_property
    def postings(self) -> DataFrame:
        chunks = self.given.agg(F.approx_count_distinct("chunk_id")).first()[0]
        runs = max(1, min(self.most_runs, -(-chunks // self.run_chunks)))
        return cut_lineage(
            self.given.select(
                "token", F.pmod(F.xxhash64("chunk_id"), F.lit(runs)).cast("int").alias("run"), "chunk_id", F.col("weight").cast("double").alias("weight")
            )
        )

    @cached_property
    def tops(self) -> DataFrame:
        return cut_lineage(
            self.postings.groupBy("token", "run").agg(F.min("weight").alias("low"), F.max("weight").alias("high"), F.count(F.lit(1)).alias("held"))
        )

    @cached_property
    def limits(self) -> DataFrame:
        return self.tops.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("held").alias("held"))

    @cached_property
    def lists(self) -> DataFrame:
        if self.by_chunk is not None:
            return self.by_chunk
        of = F.collect_list(F.struct("token", F.col("weight").cast("double").alias("weight")))
        held = self.given.groupBy("chunk_id").agg(of.alias("t"))
        return held.select("chunk_id", F.col("t.token").alias("tokens"), F.col("t.weight").alias("weights"))


def build(postings: DataFrame, run_chunks: int = RUN_CHUNKS, most_runs: int = MOST_RUNS, by_chunk: DataFrame | None = None) -> Index:
    """An index of (chunk_id, token, weight), a token once per chunk; ``by_chunk`` is the same as a row (chunk_id, tokens, weights) per chunk, if known."""
    return Index(postings, run_chunks, most_runs, by_chunk)


def _reach(weight: str = "weight"):
    """The most a token can add to a score; one a chunk lacks adds nothing."""
    w = F.col(weight)
    return F.greatest(F.lit(0.0), w * F.col("low"), w * F.col("high"))


def asked_tokens(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, token, weight, reach, held, rare): the query tokens some chunk holds, and how many do.

    A rare token is one of few chunks that lowers no score.
    """
    asked = lookup_large(queries.select("query_id", "token", F.col("weight").cast("double").alias("weight")), index.limits, ["token"], ["query_id"], how="inner")
    rare = (F.col("held") <= RARE_CHUNKS) & (F.col("weight") * F.col("low") >= 0) & (F.col("weight") * F.col("high") >= 0)
    return cut_lineage(asked.select("query_id", "token", "weight", _reach().alias("reach"), "held", rare.alias("rare")))


def _in_runs(asked: DataFrame, index: Index) -> DataFrame:
    """(asked, run, reach_run): each token in the runs that hold it. Many queries ask for the tokens many runs hold,
    so those are dealt out by run."""
    met = lookup_large(index.tops.drop("held"), asked, ["token"], ["run"], how="inner")
    return met.withColumn("reach_run", _reach()).drop("low", "high")


def _sums(wanted: DataFrame, index: Index, *carried: str) -> DataFrame:
    """(query_id, run, chunk_id, score, carried) of the rows (query_id, run, token, weight, carried)."""
    met = wanted.join(index.postings.withColumnRenamed("weight", "own"), ["token", "run"])
    return met.groupBy("query_id", "run", "chunk_id").agg(
        F.sum(F.col("weight") * F.col("own")).alias("score"), *[F.first(c).alias(c) for c in carried]
    )


def floors(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, floor): a score that ``k`` chunks reach, of queries for which a first look finds so many."""
    strong = first_n(asked, ["query_id"], [F.desc("reach"), F.col("token")], FIRST_TOKENS, ["token"]).drop("rank")
    promising = _in_runs(strong, index).groupBy("query_id", "run").agg(F.sum("reach_run").alias("promise"))
    # enough runs for k chunks where runs are full
    runs = FIRST_RUNS + -(-2 * k // RUN_CHUNKS)
    seeds = first_n(promising, ["query_id"], [F.desc("promise"), F.col("run")], runs, ["run"]).select("query_id", "run")
    scores = _sums(seeds.join(asked, "query_id"), index)
    best = first_n(scores, ["query_id"], [F.desc("score")], k, ["chunk_id"])
    return best.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")


def reaching(asked: DataFrame, index: Index, floors: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): every match that reaches the floor of its query, all where it has none.

    ``floors`` (query_id, floor) has at most one row per query.
    """
    order = Window.partitionBy("query_id").orderBy("reach", "token")
    known = lookup_large(asked, floors, ["query_id"], ["token"]).withColumn(
        "below", F.sum("reach").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    known = known.withColumn("decides", F.col("floor").isNull() | (F.col("below") >= F.col("floor") - MARGIN))
    whole = Window.partitionBy("query_id")
    known = known.withColumn("rest", F.coalesce(F.sum(F.when(~F.col("decides"), F.col("reach"))).over(whole), F.lit(0.0)))
    known = cut_lineage(known.select("query_id", "token", "weight", "floor", "decides", "rest"))
    open_ = F.col("floor").isNull()
    met = _in_runs(known.filter("decides").drop("decides"), index)
    in_run = Window.partitionBy("query_id", "run")
    met = met.withColumn("most", F.sum("reach_run").over(in_run) + F.col("rest")).filter(open_ | (F.col("most") >= F.col("floor") - MARGIN))
    may = open_ | (F.col("score") + F.col("rest") >= F.col("floor") - MARGIN)
    found = cut_lineage(_sums(met, index, "floor", "rest").filter(may))
    others = known.filter(~F.col("decides")).select("query_id", "token", "weight")
    asked_more = found.filter("rest > 0").select("query_id", "run", "chunk_id").join(others, "query_id")
    more = (
        asked_more.join(index.postings.withColumnRenamed("weight", "own"), ["token", "run", "chunk_id"])
        .groupBy("query_id", "chunk_id")
        .agg(F.sum(F.col("weight") * F.col("own")).alias("more"))
    )
    scored = found.join(more, ["query_id", "chunk_id"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return scored.filter(open_ | (F.col("score") >= F.col("floor") - MARGIN)).select(
        "query_id", "chunk_id", F.round("score", DIGITS).alias("score")
    )


def few(asked: DataFrame) -> bool:
    """Whether the queries of ``asked`` are a bounded number."""
    n, tokens = asked.agg(F.count_distinct("query_id"), F.count(F.lit(1))).first()
    return n <= SCAN_QUERIES and tokens <= SCAN_TOKENS


@dataclass(frozen=True)
class Asked:
    """Few queries: their ids, and of every token where its queries and their weights are."""

    ids: pa.Array
    tokens: pa.Array
    starts: object
    places: object
    weights: object


def asked_of(queries: DataFrame) -> Asked:
    """The rows (query_id, token, weight) of few queries, which all go to the driver."""
    import numpy as np

    rows = queries.select("query_id", "token", F.col("weight").cast("double").alias("weight")).filter("token is not null").toArrow()
    ids, tokens = (rows[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("query_id", "token"))
    order = np.argsort(tokens.indices.to_numpy(zero_copy_only=False), kind="stable")
    ends = np.cumsum(np.bincount(tokens.indices.to_numpy(zero_copy_only=False), minlength=len(tokens.dictionary)))
    weights = pc.fill_null(rows["weight"].combine_chunks(), 0.0).to_numpy(zero_copy_only=False)
    return Asked(
        ids.dictionary, tokens.dictionary, np.append(0, ends).astype(np.int64), ids.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64), weights[order]
    )


def scan(lists: DataFrame, asked: Asked, make: Callable, schema: str) -> DataFrame:
    """What a step makes of the scores of all chunks of ``lists`` (chunk_id, tokens, weights) for the queries ``asked``.

    ``make()`` gives the step of a task, a function of the chunk ids in ascending order, the scores
    (queries by chunks, rounded) and which of them match; called with None at the end of the task.
    """
    shared = lists.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        asked, step = shared.value, make()
        n = len(asked.ids)
        for batch in batches:
            if not len(batch) or not n:
                continue
            batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_start"))
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=asked.tokens), -1).to_numpy(zero_copy_only=False)
            own = pc.fill_null(batch.column(2).flatten(), 0.0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), sizes)
            row, codes, own = row[codes >= 0], codes[codes >= 0], own[codes >= 0]
            many = asked.starts[codes + 1] - asked.starts[codes]
            cost = np.cumsum(n + np.bincount(row, weights=many, minlength=len(batch)))
            begin = 0
            while begin < len(batch):
                end = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + SCAN_CELLS, "right")))
                a, b = np.searchsorted(row, [begin, end])
                m = many[a:b]
                at = np.repeat(asked.starts[codes[a:b]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                cells = asked.places[at] * (end - begin) + np.repeat(row[a:b] - begin, m)
                size = n * (end - begin)
                scores = np.bincount(cells, weights=np.repeat(own[a:b], m) * asked.weights[at], minlength=size)
                met = np.bincount(cells, minlength=size) > 0
                yield from step(batch.column(0).slice(begin, end - begin), np.round(scores, DIGITS).reshape(n, -1), met.reshape(n, -1))
                begin = end
        yield from step(None, None, None)

    return lists.select("chunk_id", "tokens", "weights").mapInArrow(run, schema)


def _id_kinds(queries: DataFrame, lists: DataFrame) -> str:
    query, chunk = queries.schema["query_id"].dataType.simpleString(), lists.schema["chunk_id"].dataType.simpleString()
    return f"query_id {query}, chunk_id {chunk}"


def _rows(ids: pa.Array, at, chunks: pa.Array, beside, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), chunks.take(pa.array(beside)), pa.array(scores)], names=["query_id", "chunk_id", "score"])


def scanned(queries: DataFrame, index: Index, lists: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score): every match of few queries; of the chunks in ``lists`` if given."""
    import numpy as np

    asked, lists = asked_of(queries), index.lists if lists is None else lists
    ids = asked.ids

    def make() -> Callable:
        def step(chunks, scores, met):
            if chunks is not None:
                at, beside = np.nonzero(met)
                yield _rows(ids, at, chunks, beside, scores[at, beside])

        return step

    return scan(lists, asked, make, f"{_id_kinds(queries, lists)}, score double")


def scanned_best(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, chunk_id, score): of few queries the ``k`` best matches of every task, and perhaps some more."""
    import numpy as np

    asked, lists = asked_of(queries), index.lists
    ids = asked.ids

    def make() -> Callable:
        floors = np.full(len(ids), -np.inf)

        def step(chunks, scores, met):
            if chunks is None:
                return
            found, owners = [], []
            for q in range(len(ids)):
                at = np.flatnonzero(met[q] & (scores[q] >= floors[q]))
                less = -scores[q, at]
                if len(at) > k:
                    at = at[less <= np.partition(less, k - 1)[k - 1]]
                    less = -scores[q, at]
                at = at[np.argsort(less, kind="stable")][:k]
                if len(at) == k:
                    floors[q] = scores[q, at[-1]]
                found.append(at)
                owners.append(np.full(len(at), q))
            at, beside = np.concatenate(owners), np.concatenate(found)
            yield _rows(ids, at, chunks, beside, scores[at, beside])

        return step

    return scan(lists, asked, make, f"{_id_kinds(queries, lists)}, score double")


def scanned_counts(queries: DataFrame, index: Index, places: DataFrame) -> DataFrame:
    """(query_id, at, n): how many matches of few queries have ``at`` of their ``places`` before them, or are the last of these.

    ``places`` (query_id, places) are (less, chunk_id) in order, a bounded number for each query.
    """
    import bisect

    import numpy as np

    known = {r.query_id: ([p.less for p in r.places], [p.chunk_id for p in r.places]) for r in places.collect()}
    asked = asked_of(queries.filter(F.col("query_id").isNotNull()))
    ids = asked.ids
    marks = [known.get(q, ([], [])) for q in ids.to_pylist()]

    def make() -> Callable:
        counts = [np.zeros(len(less) + 1, dtype=np.int64) for less, _ in marks]

        def step(chunks, scores, met):
            if chunks is None:
                at = [(q, a) for q, c in enumerate(counts) if marks[q][0] for a in np.flatnonzero(c)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([q for q, _ in at], pa.int64())), pa.array([int(a) for _, a in at], pa.int32()), pa.array([int(counts[q][a]) for q, a in at], pa.int64())],
                    names=["query_id", "at", "n"],
                )
                return
            nulls = chunks.null_count
            names = chunks.slice(nulls).to_pylist()
            for q, (less, own) in enumerate(marks):
                if not less:
                    continue
                row = np.flatnonzero(met[q])
                value, bounds = -scores[q, row], np.asarray(less)
                ahead, upto = np.searchsorted(bounds, value, "left"), np.searchsorted(bounds, value, "right")
                tied = upto > ahead
                if tied.any():
                    first, last = ahead[tied].min(), upto[tied].max()
                    for p in range(first, last):
                        ahead = ahead + ((value == bounds[p]) & (row >= nulls + bisect.bisect_left(names, own[p])))
                counts[q] += np.bincount(ahead, minlength=len(counts[q]))

        return step

    kind = queries.schema["query_id"].dataType.simpleString()
    return scan(index.lists, asked, make, f"query_id {kind}, at int, n bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of every query; Spark leaves out the others in the tasks that found them."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("chunk_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` best chunks of every query (query_id, token, weight; a token once).

    Chunks without a token of the query do not match. Scores are rounded; equal
    scores rank by the chunk.
    """
    if few(queries):
        return _ranked(scanned_best(queries, index, k), k)
    asked = asked_tokens(queries, index)
    common = common_parts(asked)
    ids = common.select("query_id").distinct().count()
    if common.select("part").distinct().count() * 2 <= ids:
        return _ranked(cut_lineage(of_common_parts(asked, common, index, k)), k)
    found = reaching(asked, index, cut_lineage(floors(asked, index, k)))
    return first_n(found, ["query_id"], [F.desc("score"), F.col("chunk_id")], k, ["chunk_id"])


def common_parts(asked: DataFrame) -> DataFrame:
    """(query_id, part, tokens): the tokens of a query that are not rare, with their weights, and a name for just these."""
    tokens = F.sort_array(F.collect_list(F.struct("token", "weight")))
    parts = asked.filter("not rare").groupBy("query_id").agg(tokens.alias("tokens"))
    return cut_lineage(parts.select("query_id", F.sha2(F.to_json("tokens"), 256).alias("part"), "tokens"))


def of_common_parts(asked: DataFrame, common: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, chunk_id, score): the matches with a rare token, and the ``k`` best of the common tokens of each query.

    Rare tokens lower no score, so a chunk that has none of them and is placed behind ``k`` others by the common
    tokens is placed behind these by all tokens.
    """
    each = common.dropDuplicates(["part"]).select(F.col("part").alias("query_id"), F.explode("tokens").alias("t"))
    tops = best(each.select("query_id", "t.token", "t.weight"), index, k)
    lists = cut_lineage(
        tops.groupBy(F.col("query_id").alias("part")).agg(F.collect_list(F.struct("chunk_id", "score")).alias("found"))
    )
    plain = lookup_large(common.select("query_id", "part"), lists, ["part"], ["query_id"], how="inner").select(
        "query_id", F.explode("found").alias("f")
    ).select("query_id", "f.chunk_id", "f.score")

    rare = asked.filter("rare").select("query_id", "token", "weight")
    holders = index.postings.join(rare.select("token").distinct(), "token", "left_semi").groupBy("token").agg(
        # RARE_CHUNKS at most
        F.collect_list(F.struct("run", "chunk_id", F.col("weight").alias("own"))).alias("held")
    )
    met = lookup_large(rare, holders, ["token"], ["query_id"], how="inner").select("query_id", "weight", F.explode("held").alias("h"))
    pairs = cut_lineage(
        met.groupBy("query_id", "h.run", "h.chunk_id").agg(F.sum(F.col("weight") * F.col("h.own")).alias("score"))
    )
    own = common.select(F.col("query_id").alias("_q"), "tokens")
    others = pairs.join(own, F.col("query_id").eqNullSafe(F.col("_q"))).select(
        "query_id", "run", "chunk_id", F.explode("tokens").alias("t")
    )
    others = cut_lineage(others.select("query_id", "run", "chunk_id", "t.token", "t.weight"))
    wanted = others.select("token", "run", "chunk_id").distinct()
    # of many queries that share a rare token all ask about the same chunks
    held = index.postings.join(wanted, ["token", "run", "chunk_id"], "left_semi").groupBy("token", "run", "chunk_id").agg(F.sum("weight").alias("own"))
    more = lookup_large(others, held, ["token", "run", "chunk_id"], ["query_id"], how="inner").select(
        "query_id", "chunk_id", (F.col("weight") * F.col("own")).alias("score")
    )
    full = pairs.select("query_id", "chunk_id", "score").unionByName(more).groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("score"), DIGITS).alias("score")
    )
    return full.unionByName(plain).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def scores_of(wanted: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, chunk_id, score) of the ``wanted`` pairs that match."""
    tokens = wanted.select("query_id", "chunk_id").join(queries.select("query_id", "token", "weight"), "query_id")
    return (
        tokens.join(index.postings.withColumnRenamed("weight", "own"), ["token", "chunk_id"])
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum(F.col("weight") * F.col("own")), DIGITS).alias("score"))
    )


def ranks_of(wanted: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, chunk_id, rank) of the ``wanted`` pairs in the full ranking of each query; pairs that do not match have none.

    ``wanted`` holds a bounded number of chunks per query. The matches down to the
    last of them are scored; each is counted for the first wanted chunk it is placed
    before, and counts are added up along the wanted ones.
    """
    queries = queries.join(wanted.select("query_id").distinct(), "query_id", "left_semi")
    scan = few(queries)
    if scan:
        pairs = wanted.select("query_id", "chunk_id").distinct()
        # few queries have few wanted chunks
        lists = index.lists.join(F.broadcast(pairs.select("chunk_id").distinct()), "chunk_id", "left_semi")
        scored = scanned(queries, index, lists).join(pairs, ["query_id", "chunk_id"], "left_semi")
    else:
        scored = scores_of(wanted, queries, index)
    scored = cut_lineage(scored)
    lists = scored.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "chunk_id"))).alias("places")
    )
    if scan:
        counts = scanned_counts(queries, index, lists).groupBy("query_id", "at").agg(F.sum("n").alias("n"))
    else:
        asked = asked_tokens(queries, index)
        least = scored.groupBy("query_id").agg(F.min("score").alias("floor"))
        rows = reaching(asked.join(least.select("query_id"), "query_id", "left_semi"), index, least)
        # how many wanted chunks are placed before a row, or are the row
        ahead = F.size(
            F.filter("places", lambda p: (p["less"] < -F.col("score")) | ((p["less"] == -F.col("score")) & (p["chunk_id"] <= F.col("chunk_id"))))
        )
        beside = lookup_large(rows, lists, ["query_id"], ["chunk_id"], how="inner")
        counts = beside.groupBy("query_id", ahead.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    places = lists.select("query_id", F.posexplode("places").alias("at", "place")).select("query_id", "at", "place.chunk_id")
    upto = Window.partitionBy("query_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a wanted row itself is counted for the place after its own
    ranked = places.join(counts, ["query_id", "at"], "left").withColumn("rank", F.sum(F.coalesce("n", F.lit(0))).over(upto) + 1)
    return ranked.select("query_id", "chunk_id", "rank")
