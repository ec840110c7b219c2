"""Topics of recent searches: scan, cluster, name, link."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from logloom.operators.clusters import MIN_CLUSTER, cluster, cluster_topics, members, memberships
from logloom.session import cut_lineage
from logloom.sources.searches import enough, recent


@dataclass(frozen=True)
class TopicRun:
    clustered: DataFrame
    topics: DataFrame
    memberships: DataFrame


def find_topics(
    searches: DataFrame,
    as_of: Column,
    min_size: int = MIN_CLUSTER,
    eps: float | None = None,
) -> TopicRun:
    """All datasets in one run, each whole; ``searches`` carry ``query_vector``."""
    found = cut_lineage(enough(recent(searches, as_of), min_size))
    points = found.withColumnRenamed("query_vector", "vector")
    clustered = cut_lineage(cluster(points, min_size, eps))
    rows = members(clustered, found.select("dataset_id", "id", "query", "top_score"))
    topics = cluster_topics(rows, as_of)
    return TopicRun(clustered, topics, memberships(rows, topics))
