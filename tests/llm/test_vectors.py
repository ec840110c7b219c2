import math

import numpy as np
import pytest

from logloom.llm import vectors
from logloom.llm.common import roots

SCHEMA = "vec_id long, embedding array<float>, label int, id int, mark string"


def brute(rows, threshold=0.9):
    """(links, component) per row by all pairs."""
    sound = [
        v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows
    ]
    n = len(rows)
    near = np.zeros((n, n), bool)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if s else None for (_, v), s in zip(rows, sound)]
    for i in range(n):
        for j in range(i):
            if sound[i] and sound[j] and len(unit[i]) == len(unit[j]):
                near[i, j] = near[j, i] = unit[i] @ unit[j] >= threshold
    a, b = np.nonzero(near)
    label = roots(n, a, b)
    names = [min((rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None), default=None) for i in range(n)]
    return [(rows[i][0], int(near[i].sum()), names[i]) for i in range(n)]


def run(spark, rows, **kw):
    frame = spark.createDataFrame([(i, v, 1, 2, "m") for i, v in rows], SCHEMA)
    return sorted(map(tuple, vectors.near_vectors(frame, **kw).collect()), key=repr)


def clusters(rng, sizes, dim=16, spread=0.08):
    out = []
    for size in sizes:
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        out += [(centre + rng.normal(size=dim) * spread).astype("f4").tolist() for _ in range(size)]
    return out


def test_small_tables_are_compared_whole(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(clusters(rng, [1] * 30 + [2, 3, 5, 40])))
    rng.shuffle(rows)
    rows = [(int(i), v) for i, v in rows]
    assert run(spark, rows) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("window", [16, 64])
def test_recall_with_many_tiles_and_a_dense_cluster(spark, window):
    rng = np.random.default_rng(3)
    rows = list(enumerate(clusters(rng, [1] * 400 + [4] * 60 + [300], spread=0.05)))
    got, want = run(spark, rows, window=window), sorted(brute(rows), key=repr)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    # never more than there is, no pair twice
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)))
    assert found >= 0.95 * there
    assert np.mean([g[2] == w[2] for g, w in zip(sorted(got), sorted(want))]) > 0.98


def test_passes_follow_from_rows_and_recall():
    assert vectors.passes_for(100, 0.9, 512, 0.98)[0] == 1
    few, many = vectors.passes_for(50_000, 0.9, 512, 0.98)[0], vectors.passes_for(10**9, 0.9, 512, 0.98)[0]
    assert 1 < few < many < 200


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]),
        (None, [1.0, 0.0]), (13, [1.0, 0.0, 0.0]), (14, [3e38, 3e38]), (15, [1e-40, 1e-40]), (None, None),
    ]
    got = run(spark, rows)
    assert got == sorted(brute([(i, v) for i, v in rows]), key=repr)


def test_doubles_and_other_names(spark):
    frame = spark.createDataFrame([(1, [1e200, 0.0]), (2, [1e200, 1e199]), (3, [0.0, 1.0])], "n long, v array<double>")
    got = sorted(map(tuple, vectors.near_vectors(frame, id_col="n", vector_col="v").collect()))
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_empty_table(spark):
    assert run(spark, []) == []


def off_centre(rng, n, dim=64, inner=16):
    """Vectors of ``inner`` dimensions, tilted towards one direction: mean cosine about 0.7."""
    base = rng.normal(size=(inner, dim)) / np.sqrt(inner)
    v = rng.normal(size=(n, inner)) @ base
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tilt = rng.normal(size=dim)
    return v + 1.6 * tilt / np.linalg.norm(tilt)


def test_recall_on_off_centre_vectors_of_few_dimensions(spark):
    rng = np.random.default_rng(8)
    v = off_centre(rng, 49_000)
    near = v[:1000] + rng.normal(size=(1000, 64)) * 0.05
    v = np.concatenate([v, near]).astype("f4")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    assert 0.6 < np.mean(unit[:200] @ unit[200:400].T) < 0.8
    true = np.concatenate([(unit[i : i + 1000] @ unit.T >= 0.9).sum(axis=1) - 1 for i in range(0, len(unit), 1000)])
    frame = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>")
    got = {r.id: r.n_links for r in vectors.near_vectors(frame.repartition(8)).collect()}
    found = np.array([got[i] for i in range(len(v))])
    assert (found <= true).all() and true.sum() > 100_000
    assert found.sum() >= 0.95 * true.sum()
    # a near copy of a row is linked with something
    assert (found[49_000:] > 0).mean() >= 0.95


def test_plan_follows_the_cells():
    even = {s: max(1.0, 50_000 / 2**s) for s in vectors.signs_tried(50_000, 512)}
    crowded = {s: max(1.0, 50_000 / 1.3**s) for s in even}
    for crowd in (even, crowded):
        passes, signs = vectors.cheapest(crowd, 50_000, 0.9, 512, 0.98)
        together = (1 - math.acos(0.9) / math.pi) ** signs
        assert 1 - (1 - together) ** passes >= 0.98
    assert vectors.cheapest(crowded, 50_000, 0.9, 512, 0.98)[1] >= vectors.cheapest(even, 50_000, 0.9, 512, 0.98)[1]


def test_planted_links_at_the_size_of_the_query(spark):
    """The given vectors with near copies of some: every planted link is found, none besides true ones."""
    rng = np.random.default_rng(4)
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rows = given + [(10**6 + i, (np.array(v) + rng.normal(size=len(v)) * 0.02).tolist()) for i, v in given[::3]]
    unit = np.array([v for _, v in rows], dtype="f4").astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.id: r for r in vectors.near_vectors(frame).collect()}
    assert [got[i].n_links for i, _ in rows] == (near.sum(axis=1) - 1).tolist() and (near.sum(axis=1) > 1).sum() > 1000
    assert all(got[10**6 + i].component_id <= i for i, _ in given[::3])
