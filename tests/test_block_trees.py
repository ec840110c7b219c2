"""Trees of many small blocks are joined within tasks before they are passed on."""

import numpy as np

from logloom.operators import density


def test_trees_of_parts_are_joined_in_the_task(spark):
    rng = np.random.default_rng(9)
    centres = [(0, 0, 0), (9, 0, 0), (0, 30, 0)]
    rows = [("d", f"{k}-{i:03d}", (np.array(c) + rng.normal(size=3)).tolist()) for k, c in enumerate(centres) for i in range(50)]
    frame = spark.createDataFrame(rows, "dataset_id string, id string, vector array<double>")
    found = lambda block: {r.id: (r.label, round(r.prob, 9)) for r in density.density_clusters(frame, 10, block).collect()}
    assert found(6) == found(2048)
    from pyspark.sql import functions as F

    points = frame.withColumn("core", F.lit(0.1))
    # four blocks of 48: no pair passes on more than a tree of its rows
    assert density.block_trees(points, 6).count() < 10 * 110


def test_a_large_dataset_is_copied_a_few_times(spark):
    from pyspark.sql import functions as F

    rows = spark.range(600_000).select(F.when(F.col("id") < 40, "small").otherwise("large").alias("dataset_id"), F.col("id").cast("string").alias("id"))
    for most in (None, density.TREE_BLOCK * density.TREE_BLOCKS):
        blocks = dict(density.in_blocks(rows, most).select("dataset_id", "_blocks").distinct().collect())
        assert blocks["small"] == 1 and 6 <= blocks["large"] <= 8


def test_shuffle_files_go_with_what_made_them(spark):
    import time

    from logloom.session import cut_lineage, release

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return names

    before = files()
    kept = cut_lineage(spark.range(100_000).groupBy("id").count().repartition(9, "count", "id"))
    made = files() - before
    # the cleaner may still be busy with what tests before left
    for _ in range(10):
        release(spark)
        time.sleep(1)
        if not made & files():
            break
    assert made and not made & files() and kept.count() == 100_000
