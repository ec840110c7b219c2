"""Rerank candidates with a pair model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.models import pair_scores


def rerank(candidates: DataFrame, top_k: int = 3, make=None) -> DataFrame:
    """Best ``top_k`` candidates per query by model score, with ``cross_encoder_score``.

    Rows (query_id, query, chunk_id, content, rank). If the model fails on any
    candidate of a query, the query keeps its original order and null scores.
    """
    scored = pair_scores(candidates, "query", "content", make)
    per_query = Window.partitionBy("query_id")
    failed = F.max(F.col("cross_encoder_score").isNull()).over(per_query)
    usable = scored.withColumn(
        "cross_encoder_score", F.when(~failed, F.col("cross_encoder_score"))
    )
    order = per_query.orderBy(F.desc_nulls_last("cross_encoder_score"), F.col("rank"))
    return (
        usable.withColumn("new_rank", F.row_number().over(order))
        .filter(F.col("new_rank") <= top_k)
    )
