"""Core distances and reach by unordered pairs of blocks, a row per point and pair."""

import numpy as np

from logloom.operators import blocks, clusters


def test_core_distances_pass_on_a_row_per_point_and_pair(spark, monkeypatch):
    monkeypatch.setattr(clusters, "POINT_BLOCK", 40)
    monkeypatch.setattr(blocks, "AT_ONCE", 700, raising=False)
    x = np.random.default_rng(2).normal(size=(200, 6)).round(3)
    x[7] = x[3]
    frame = spark.createDataFrame([("d", f"p{i:03d}", v.tolist()) for i, v in enumerate(x)], "dataset_id string, id string, vector array<double>")
    seen = []
    pairs = clusters.paired_blocks
    monkeypatch.setattr(clusters, "paired_blocks", lambda *a: seen.append(pairs(*a)) or seen[-1])
    got = {r.id: r.core for r in clusters.core_distances(frame, 9).collect()}
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 6)
    want = np.sort(d, axis=1)[:, 8]
    assert [got[f"p{i:03d}"] for i in range(200)] == want.tolist()
    assert seen[0].count() == 200 * 5
    # the same components as over all pairs
    eps = float(np.quantile(want, 0.5))
    found = {r.id: r.label for r in clusters.cluster(frame, 9, eps=eps).collect()}
    dense = np.flatnonzero(want <= eps)
    label = {i: i for i in dense}
    for _ in dense:
        for i in dense:
            for j in dense[d[i, dense] <= eps]:
                label[i] = label[j] = min(label[i], label[j])
    sizes = {n: sum(v == n for v in label.values()) for n in label.values()}
    want_label = {f"p{i:03d}": f"p{n:03d}" for i, n in label.items() if sizes[n] >= 9}
    assert {i: n for i, n in found.items() if n} == want_label


def test_core_distances_of_a_pair_of_blocks_hold_a_tile(spark, monkeypatch):
    """What a pair of blocks compares is not kept: 2,500 x 2,500 distances are 50 MB, held by views of their rows' least."""
    import tracemalloc

    import pandas as pd

    seen = []
    pairs = clusters.paired_blocks
    monkeypatch.setattr(clusters, "paired_blocks", lambda *a: seen.append(a[3]) or pairs(*a))
    monkeypatch.setattr(blocks, "TILE", 256, raising=False)
    x = np.random.default_rng(5).normal(size=(5000, 4)).round(3)
    frame = spark.createDataFrame([("d", "p", [0.0] * 4)], "dataset_id string, id string, vector array<double>")
    clusters.core_distances(frame, 9)
    sides = [pd.DataFrame({"dataset_id": "d", "id": np.arange(s, s + 2500)}) for s in (0, 2500)]
    tracemalloc.start()
    got = pd.concat(seen[0](*sides, x[:2500], x[2500:], False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6
    for i in (0, 1234, 4999):
        other = x[2500:] if i < 2500 else x[:2500]
        want = np.sort(np.round(np.sqrt(((x[i] - other) ** 2).sum(-1)), 6))[:9]
        assert np.allclose(np.sort(got[got["id"] == i]["least"].iloc[0]), want, atol=1e-9)


def test_links_within_reach_hold_a_tile(spark, monkeypatch):
    """The forest of a pair of blocks joins what all pairs of points join, and holds a tile of distances at a time."""
    import tracemalloc

    import pandas as pd

    seen = []
    pairs = clusters.paired_blocks
    monkeypatch.setattr(clusters, "paired_blocks", lambda *a: seen.append(a[3]) or pairs(*a))
    monkeypatch.setattr(blocks, "TILE", 256, raising=False)
    x = np.random.default_rng(6).normal(size=(4000, 3)).round(3)
    kinds = "dataset_id string, id string, vector array<double>, core double, eps double"
    clusters.reachability_edges(spark.createDataFrame([("d", "p", [0.0] * 3, 0.1, 0.2)], kinds))
    l, r = [pd.DataFrame({"dataset_id": "d", "id": np.arange(s, s + 2000), "eps": 0.2}) for s in (0, 2000)]

    def parts(links):
        up = list(range(4000))
        for a, b in links:
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        label = []
        for i, u in enumerate(up):
            label.append(i if u == i else label[u])
        return label

    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 6) <= 0.2
    for alone in (False, True):
        tracemalloc.start()
        got = pd.concat(seen[0](l, l if alone else r, x[:2000], x[:2000] if alone else x[2000:], alone))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        near = np.argwhere(d[:2000, :2000]) if alone else np.argwhere(d[:2000, 2000:]) + [0, 2000]
        assert parts(got[["a", "b"]].to_numpy().tolist()) == parts(near.tolist())
        assert 0 < len(got) < 4000 and peak < 15e6


def test_members_stats_and_memberships_of_many_blocks(spark, monkeypatch):
    """What follows from the clusters is the same for one block and for many."""
    from pyspark.sql import functions as F

    from logloom.plans.topics import find_topics

    rng = np.random.default_rng(8)
    rows = [("d", f"p{i:03d}", 0, 0, f"text {i % 4}", i / 200, (rng.normal(size=4) * 0.2 + (i % 3) * 5).round(3).tolist()) for i in range(180)]
    searches = spark.createDataFrame(
        rows, "dataset_id string, id string, created_at long, is_duplicate int, query string, top_score double, query_vector array<double>"
    )
    found = []
    for most in (10**6, 37):
        monkeypatch.setattr(clusters, "POINT_BLOCK", most)
        run = find_topics(searches, F.lit(0), 12)
        rows = clusters.members(run.clustered, searches.select("dataset_id", "id", "query", "top_score"))
        top = clusters.top_members(rows).select("label", "id", "rank")
        stats = clusters.cluster_stats(rows).withColumn("avg_score", F.round("avg_score", 9))
        found.append([sorted(map(tuple, f.collect())) for f in (rows.select("id", "label", "prob"), top, stats, run.memberships)])
    assert found[0] == found[1] and len(found[0][2]) == 3 and len(found[0][3]) == len(found[0][0]) > 150
