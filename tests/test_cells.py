"""Vector search: a query goes to a group of cells once, whatever cells it visits."""

import numpy as np

from logloom.operators import blocks, cells


def test_vectors_without_clusters_are_copied_per_group(spark, monkeypatch):
    monkeypatch.setattr(cells, "GROUP_ROWS", 300, raising=False)
    monkeypatch.setattr(blocks, "AT_ONCE", 4000, raising=False)
    x = np.random.default_rng(4).normal(size=(900, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    index = cells.build(spark.createDataFrame(rows, "chunk_id int, vector array<double>"))
    asked = spark.createDataFrame(rows, "query_id int, vector array<double>")
    found = cells.best(asked, index, 4)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    for q in range(900):
        order = np.lexsort([np.arange(900), -scores[q]])
        assert [c for _, c in sorted(got[q])] == order[:4].tolist()
    # thirty cells, most of them in reach, in a few groups
    floor = found.filter("rank = 4").selectExpr("query_id", "score as floor")
    rest = cells.visits(asked, index, 4, floor).selectExpr("query_id", "size(cells) as n").collect()
    assert len(rest) <= 900 * 6 < sum(r.n for r in rest)
