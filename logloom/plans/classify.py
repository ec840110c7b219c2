"""Classify log messages against the chunk table, and assemble answers' contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.models import embed
from logloom.functions.spread import lookup_large
from logloom.operators.rerank import rerank
from logloom.operators.retrieval import contexts, search
from logloom.session import cut_lineage

# Fixed value: the answer text while no model is attached
PLACEHOLDER = "Placeholder LLM response"


def distinct_messages(logs: DataFrame, message: str = "message") -> DataFrame:
    """Each distinct text once as a query: copies of a log line are searched a single time."""
    text = F.coalesce(F.col(message), F.lit(""))
    return logs.select(text.alias("query")).distinct().withColumn("query_id", F.md5("query"))


def classify(
    logs: DataFrame,
    chunks: DataFrame,
    k: int = 3,
    search_type: str = "hybrid",
    id_column: str = "log_id",
    message: str = "message",
    encoder=None,
    reranker=None,
    candidates: int | None = None,
) -> DataFrame:
    """Logs with ``classifications``: the top ``k`` chunks as array of (rank, chunk_id, score).

    ``chunks`` need a ``vector`` column for the search types that use one; the
    messages are encoded here. With ``reranker``, a pair-model factory, the
    search fetches ``candidates`` chunks and the model orders them.
    """
    if reranker and candidates is None:
        raise ValueError("a reranker needs a number of candidates")
    queries = distinct_messages(logs, message)
    if search_type in ("semantic", "hybrid"):
        queries = embed(queries, "query", encoder)
    queries = cut_lineage(queries)
    found = search(queries, chunks, search_type, candidates if reranker else k)
    if reranker:
        texts = found.join(queries.select("query_id", "query"), ["query_id"]).join(
            chunks.select("chunk_id", "content"), ["chunk_id"]
        )
        ranked = rerank(texts, k, reranker)
        found = ranked.select(
            "query_id", "chunk_id",
            F.coalesce("cross_encoder_score", "score").alias("score"),
            F.col("new_rank").alias("rank"),
        )
    nested = found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("classifications")
    )
    keyed = logs.withColumn("query_id", F.md5(F.coalesce(F.col(message), F.lit(""))))
    none = F.expr("array()").cast(nested.schema["classifications"].dataType)
    return lookup_large(keyed, nested, ["query_id"], [id_column]).withColumn(
        "classifications", F.coalesce("classifications", none)
    ).drop("query_id")


def best_class(classified: DataFrame) -> DataFrame:
    """Best chunk and its confidence per log, ready to append to a classification table."""
    first = F.try_element_at("classifications", F.lit(1))
    return classified.withColumn("class_chunk", first["chunk_id"]).withColumn(
        "confidence", first["score"]
    ).drop("classifications")


def answer(
    queries: DataFrame,
    chunks: DataFrame,
    context_size: int = 3,
    search_type: str = "hybrid",
) -> DataFrame:
    """(query_id, query, context, response, raw_results) per query."""
    found = search(queries, chunks, search_type, context_size)
    texts = found.join(chunks.select("chunk_id", "content"), ["chunk_id"])
    raw = texts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "content"))).alias("raw_results")
    )
    empty = F.expr("array()")
    return (
        queries.select("query_id", "query")
        .join(contexts(texts), ["query_id"], "left")
        .join(raw, ["query_id"], "left")
        .select(
            "query_id",
            "query",
            F.coalesce("context", empty.cast("array<string>")).alias("context"),
            F.lit(PLACEHOLDER).alias("response"),
            F.coalesce("raw_results", empty.cast(raw.schema["raw_results"].dataType)).alias("raw_results"),
        )
    )
