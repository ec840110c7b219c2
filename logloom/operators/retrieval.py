"""Search of many queries over many chunks: lexical, semantic, sparse and hybrid."""

from __future__ import annotations

import datetime
import decimal
import operator
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.spread import lookup_large
from logloom.functions.text import tokens
from logloom.operators import cells, postings
from logloom.session import cut_lineage

# BM25 and rank-fusion constants from the literature
K1 = 1.2
B = 0.75
RRF = 60


def bm25_weights(
    queries: DataFrame, chunks: DataFrame, k1: float = K1, b: float = B
) -> tuple[DataFrame, postings.Index]:
    """BM25 as a dot product: (query_id, token, weight) and an index of (chunk_id, token, weight).

    The inverse document frequency goes to the query side and the saturated term
    frequency to the chunk side, so frequencies are never joined to postings.
    Chunks are tokenised once: the postings keep the tokens some query asks for,
    and the length of every chunk. Where these tokens are few, a chunk's are
    counted where its text is.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens("query"))).alias("token"))
    wanted = asked.select("token").distinct()
    some = [r.token for r in wanted.limit(postings.SCAN_TOKENS + 1).collect()]
    few, repeated = len(some) <= postings.SCAN_TOKENS, False
    if few:
        repeated = not chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        lists = _counts(chunks, some)
        if repeated:
            # texts of one chunk and length count together
            rows = lists.select("chunk_id", "len", F.explode_outer(F.arrays_zip("tokens", "counts")).alias("t"))
            rows = rows.groupBy("chunk_id", "len", F.col("t.tokens").alias("token")).agg(F.sum("t.counts").alias("f"))
            pair = F.when(F.col("token").isNotNull(), F.struct("token", "f"))
            lists = rows.groupBy("chunk_id", "len").agg(F.collect_list(pair).alias("t"))
            lists = lists.select("chunk_id", "len", F.col("t.token").alias("tokens"), F.col("t.f").alias("counts"))
        lists = cut_lineage(lists)
        lengths = lists.select("len")
        held = lists.select("chunk_id", "len", F.explode(F.arrays_zip("tokens", "counts")).alias("t")).select(
            "chunk_id", "len", F.col("t.tokens").alias("token"), F.col("t.counts").alias("f")
        )
    else:
        # an empty token carries the length of a chunk
        carried = wanted.unionByName(queries.sparkSession.range(1).select(F.lit("").alias("token")))
        counted = cut_lineage(
            chunks.select("chunk_id", tokens("content").alias("_t"))
            .select(
                "chunk_id",
                F.size("_t").alias("len"),
                F.explode_outer(F.array_append("_t", F.lit(""))).alias("token"),
            )
            .join(carried, ["token"], "left_semi")
            .groupBy("chunk_id", "len", "token")
            .agg(F.count(F.lit(1)).alias("f"))
        )
        lengths, held = counted.filter("token = ''"), counted.filter("token <> ''")
    totals = lengths.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))).scalar()
    frequency = held.groupBy("token").agg(F.count(F.lit(1)).alias("d"))
    idf = F.log(F.lit(1) + (F.col("_totals.n") - F.col("d") + 0.5) / (F.col("d") + 0.5))
    query_side = (
        lookup_large(asked, frequency, ["token"], ["query_id"], how="inner")
        .withColumn("_totals", totals)
        .select("query_id", "token", idf.alias("weight"))
    )

    def saturated(f: Column) -> Column:
        return f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.col("_totals.avg_len")))

    chunk_side = held.withColumn("_totals", totals).select("chunk_id", "token", saturated(F.col("f")).alias("weight"))
    by_chunk = None
    if few and not repeated:
        by_chunk = lists.withColumn("_totals", totals).select("chunk_id", "tokens", F.transform("counts", saturated).alias("weights"))
    return cut_lineage(query_side), postings.build(chunk_side, by_chunk=by_chunk)


def _counts(chunks: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(chunk_id, len, tokens, counts): the number of tokens of every text, and which of the ``wanted`` it holds how often."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    shared = chunks.sparkSession.sparkContext.broadcast(list(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known = pa.array(shared.value, pa.string())
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            codes = pc.fill_null(pc.index_in(batch.column(2).flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            keys = np.repeat(np.arange(len(batch)), sizes) * np.int64(len(known)) + codes
            held, counts = np.unique(keys[codes >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(held, np.arange(len(batch) + 1) * np.int64(len(known))).astype(np.int32))
            held = known.take(pa.array(held % max(1, len(known))))
            lists = [pa.ListArray.from_arrays(ends, held), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["chunk_id", "len", "tokens", "counts"])

    rows = chunks.select("chunk_id", tokens("content").alias("_t")).filter("_t is not null")
    return rows.select("chunk_id", F.size("_t").alias("len"), "_t").mapInArrow(
        count, f"chunk_id {kind}, len int, tokens array<string>, counts array<bigint>"
    )


def lexical(queries: DataFrame, chunks: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 top ``k``: (query_id, chunk_id, score, rank)."""
    left, right = bm25_weights(queries, chunks, k1, b)
    return postings.best(left, right, k)


def sparse(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Top ``k`` by dot product of ``weights`` maps (token to weight), as a learned sparse encoder gives."""
    left = queries.select("query_id", F.explode("weights").alias("token", "weight"))
    right = chunks.select("chunk_id", F.explode("weights").alias("token", "weight"))
    wanted = left.select("token").distinct()
    return postings.best(left, postings.build(right.join(wanted, "token", "left_semi")), k)


def semantic(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Top ``k`` by cosine of ``vector`` columns."""
    return cells.best(_with_vector(queries, "query_id"), cells.build(_with_vector(chunks, "chunk_id")), k)


def _with_vector(frame: DataFrame, key: str) -> DataFrame:
    return frame.select(key, "vector").filter(F.col("vector").isNotNull())


def hybrid(queries: DataFrame, chunks: DataFrame, k: int, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of the full lexical and semantic rankings, top ``k``.

    The score of a chunk is the sum of 1/(constant + rank) over the two
    rankings. Only the first ``constant + 2k`` of each are computed at once: a
    chunk outside both scores at most 2/(2 constant + 2k + 1), less than the
    1/(constant + k) that the first k of either ranking reach, so no chunk of
    the result is missed. Ranks beyond that depth are then counted exactly for
    the few chunks they could lift into the result.
    """
    depth = constant + 2 * k
    left_words, right_words = bm25_weights(queries, chunks)
    left_vectors = _with_vector(queries, "query_id")
    words, groups = right_words, cells.build(_with_vector(chunks, "chunk_id"))
    found = {"lexical": postings.best(left_words, words, depth), "semantic": cells.best(left_vectors, groups, depth)}
    tops = None
    for name, top in found.items():
        top = top.select("query_id", "chunk_id", F.lit(name).alias("ranking"), F.col("rank").cast("bigint").alias("rank"))
        tops = top if tops is None else tops.unionByName(top)
    tops = cut_lineage(tops)

    known = _fused(tops, constant)
    missing = sum(F.when(F.col(name).isNull(), 1).otherwise(0) for name in found)
    bounds = known.withColumn("_top", F.col("score") + missing / F.lit(constant + depth + 1.0))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    floor = (
        known.withColumn("_r", F.row_number().over(best))
        .filter(F.col("_r") == k)
        .select("query_id", F.col("score").alias("_floor"))
    )
    open_pairs = cut_lineage(
        bounds.join(floor, ["query_id"], "left").filter(
            F.col("_floor").isNull() | (F.col("_top") >= F.col("_floor") - 1e-9)
        )
    )
    ranks = tops.join(open_pairs.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    for name in found:
        wanted = open_pairs.filter(F.col(name).isNull()).select("query_id", "chunk_id")
        if wanted.isEmpty():
            continue
        if name == "lexical":
            deeper = postings.ranks_of(wanted, left_words, words)
        else:
            deeper = cells.ranks_of(wanted, left_vectors, groups)
        ranks = ranks.unionByName(deeper.withColumn("ranking", F.lit(name)))
    scores = _fused(ranks, constant).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("chunk_id"))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _fused(ranks: DataFrame, constant: int) -> DataFrame:
    return ranks.groupBy("query_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (constant + F.col("rank"))).alias("score"),
        *[
            F.max(F.when(F.col("ranking") == name, F.col("rank"))).alias(name)
            for name in ("lexical", "semantic")
        ],
    )


def in_range(value: Column, bounds: Mapping[str, object]) -> Column:
    """Whether a text value lies within ``bounds``: any of ``gt``, ``gte``, ``lt`` and ``lte``.

    With numbers as bounds the text is read as a number, with dates or times as a
    time, which a date alone names the first moment of. Text that is neither, or
    missing, lies in no range, nor does NaN.
    """
    within = F.lit(True)
    for name, bound in bounds.items():
        if isinstance(bound, datetime.date):
            own, end = F.try_to_timestamp(value), F.lit(bound).cast("timestamp")
        elif isinstance(bound, (int, float, decimal.Decimal)) and not isinstance(bound, bool):
            # whole numbers and decimals are compared exactly: doubles would blur large ids
            kind = "double" if isinstance(bound, float) else "decimal(38,9)"
            own, end = value.try_cast(kind), F.lit(bound).cast(kind)
            own = F.when(~F.isnan(value.try_cast("double")), own)
        else:
            raise TypeError(f"neither number nor date: {bound!r}")
        within = within & F.coalesce(COMPARISONS[name](own, end), F.lit(False))
    return within


COMPARISONS = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}

SEARCHES = {"bm25": lexical, "splade": sparse, "semantic": semantic, "hybrid": hybrid}


def search(
    queries: DataFrame,
    chunks: DataFrame,
    search_type: str = "hybrid",
    limit: int = 5,
    score_threshold: float | None = None,
    tags: Sequence[str] = (),
    metadata: Mapping[str, str] | None = None,
    members: DataFrame | None = None,
    ranges: Mapping[str, Mapping[str, object]] | None = None,
) -> DataFrame:
    """Top ``limit`` chunks per query by one of the four search types.

    Filters choose the chunks that are searched: those with any of ``tags``, with
    all of the ``metadata`` values, among the ``members`` (chunk_id) of a group, and
    with metadata inside all of the ``ranges`` (see :func:`in_range`).
    """
    if tags:
        chunks = chunks.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    for key, value in (metadata or {}).items():
        chunks = chunks.filter(F.element_at("metadata", key) == value)
    for key, bounds in (ranges or {}).items():
        chunks = chunks.filter(in_range(F.element_at("metadata", key), bounds))
    if members is not None:
        chunks = chunks.join(members.select("chunk_id").distinct(), "chunk_id", "left_semi")
    found = SEARCHES[search_type](queries, chunks, limit)
    return found if score_threshold is None else found.filter(F.col("score") >= score_threshold)


def context_line(content: str = "content", score: str = "score") -> Column:
    """``<content> [Score: <score>]`` with an empty text and 0 for what is missing."""
    return F.format_string(
        "%s [Score: %s]",
        F.coalesce(F.col(content), F.lit("")),
        F.coalesce(F.col(score).cast("string"), F.lit("0")),
    )


def contexts(results: DataFrame) -> DataFrame:
    """Context lines of each query in rank order."""
    lines = results.select("query_id", F.struct("rank", context_line().alias("line")).alias("e"))
    return (
        lines.groupBy("query_id")
        .agg(F.array_sort(F.collect_list("e")).alias("e"))
        .select("query_id", F.col("e.line").alias("context"))
    )
