"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The given tables are single files, which a cluster's tables are not: they are
first rewritten in several files, and the raw log payloads are landed, untimed.
Each query runs once to warm up and then ``$BENCH_RUNS`` times; the best counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from logloom.operators import catalogue_checks as checks  # noqa: E402
from logloom.operators import clusters, retrieval  # noqa: E402
from logloom.operators.collapse import neighbour_marks, superseded  # noqa: E402
from logloom.plans.ingest import ingest  # noqa: E402
from logloom.session import local_session, scratch_path  # noqa: E402
from logloom.sources.searches import first_scan  # noqa: E402
from workload import catalogue, ingest as logs, retrieval as search_work, search  # noqa: E402
from workload.clusters import points  # noqa: E402
from workload.inputs import CHUNKS, QUERIES, TABLES, raw_logs, view  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def split_tables(spark, path: str) -> str:
    out = scratch_path(spark, "bench")
    for table in TABLES:
        frame = spark.read.parquet(f"{path}/{table}.parquet")
        files = 2 * CPUS if table in ("documents", "events", "lineitem", "orders", "conversations") else 1
        frame.repartition(files).write.parquet(f"{out}/{table}.parquet")
    raw_logs(spark, out).write.parquet(f"{out}/raw")
    return out


def queries(spark, path: str) -> dict:
    def raw():
        return spark.read.parquet(f"{path}/raw")

    def class_counts():
        rows = ingest(raw(), now=logs.now()).filter(F.col("route") == "windows")
        return rows.groupBy("mapped_class_name", "mapped_severity", "mapped_status", "criticality").count()

    def validated():
        return ingest(raw(), logs.RULES, logs.now())

    def scanned():
        return first_scan(search.searches(spark, path))

    def inheritance():
        classes, fields = catalogue.classes(spark, path), catalogue.fields(spark, path)
        issues = checks.inheritance_issues(classes, fields).select("type", "message")
        refs = checks.reference_issues(classes, fields).select("type", "message")
        return issues.unionByName(refs)

    return {
        "map_and_count": class_counts,
        "map_and_validate": validated,
        "collapse_later": lambda: superseded(scanned()),
        "collapse_neighbours": lambda: neighbour_marks(scanned()),
        "lexical_top3": lambda: retrieval.search(view(spark, path, QUERIES), view(spark, path, CHUNKS), "bm25", 3),
        "semantic_top3": lambda: search_work.search_semantic(spark, path),
        "hybrid_top3": lambda: retrieval.search(
            search_work.queries(spark, path), search_work.chunks(spark, path), "hybrid", 3
        ),
        "catalogue_issues": inheritance,
        "inheritance_depth": lambda: catalogue.inheritance_depth(spark, path),
        "inheritance_cycles": lambda: catalogue.inheritance_cycles(spark, path),
        "field_reference": lambda: catalogue.usage_patterns(spark, path),
        "density_clusters": lambda: clusters.cluster(points(spark, path)),
    }


def main() -> None:
    spark = local_session("bench", CPUS)
    path = split_tables(spark, SF_DIR)
    seconds = {}
    for name, build in queries(spark, path).items():
        best = None
        for run in range(RUNS + 1):
            start = time.time()
            build().write.format("noop").mode("overwrite").save()
            took = time.time() - start
            if run and (best is None or took < best):
                best = took
        seconds[name] = round(best, 3)
        print(f"{name}: {best:.2f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
