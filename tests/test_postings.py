"""Searches of many queries with common tokens, and of few queries over the postings read once."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import postings

CHUNKS = "chunk_id int, token string, weight double"
QUERIES = "query_id int, token string, weight double"


def brute(rows, asked, k):
    held, out = {}, {}
    for c, t, w in rows:
        held.setdefault(t, []).append((c, w))
    for q, t, w in asked:
        for c, own in held.get(t, ()):
            out.setdefault(q, {})
            out[q][c] = out[q].get(c, 0.0) + w * own
    ranked = {q: sorted((-round(s, 6), c) for c, s in found.items()) for q, found in out.items()}
    return {q: [(c, pytest.approx(-s)) for s, c in found[:k]] for q, found in ranked.items() if found}


def got(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
    return {q: [e[1:] for e in sorted(rows)] for q, rows in out.items()}


def data():
    rng = random.Random(8)
    rows = [(c, "class:", 1.0 if c % 3 else 1.5) for c in range(400)] + [(c, f"c{c}", 2.0) for c in range(400)]
    rows += [(c, "shared", rng.random()) for c in range(0, 400, 3)] + [(c, "minus", -1.0) for c in (5, 6, 7)]
    asked = [(q, "class:", 0.5) for q in range(600)] + [(q, f"c{q}", 3.0) for q in range(600)]
    asked += [(q, "shared", 1.0) for q in range(0, 600, 2)] + [(q, "minus", 2.0) for q in (5, 7, 9)]
    return rows, asked


def test_queries_of_one_common_part_are_searched_once(spark, monkeypatch):
    monkeypatch.setattr(postings, "SCAN_QUERIES", 0, raising=False)
    asked_for = []
    floors = postings.floors

    def spied(asked, index, k):
        asked_for.append(asked.count())
        return floors(asked, index, k)

    monkeypatch.setattr(postings, "floors", spied)
    rows, asked = data()
    index = postings.build(spark.createDataFrame(rows, CHUNKS))
    found = got(postings.best(spark.createDataFrame(asked, QUERIES), index, 3))
    assert found == brute(rows, asked, 3)
    assert sum(asked_for) < 30


def test_few_queries_read_the_postings_once(spark, monkeypatch):
    def none(*_):
        raise AssertionError("runs are looked at")

    monkeypatch.setattr(postings, "floors", none)
    monkeypatch.setattr(postings, "reaching", none)
    rows, asked = data()
    asked = [r for r in asked if r[0] < 20]
    index = postings.build(spark.createDataFrame(rows, CHUNKS))
    queries = spark.createDataFrame(asked, QUERIES)
    want = brute(rows, asked, 400)
    assert got(postings.best(queries, index, 4)) == {q: found[:4] for q, found in want.items()}
    wanted = [(q, want[q][i][0]) for q in (0, 5, 8) for i in (0, 7, 200)]
    ranks = postings.ranks_of(spark.createDataFrame(wanted, "query_id int, chunk_id int"), queries, index).collect()
    assert sorted((r.query_id, r["rank"]) for r in ranks) == [(q, i + 1) for q in (0, 5, 8) for i in (0, 7, 200)]
    plan = postings.scanned(postings.asked_tokens(queries, index), index)._jdf.queryExecution().executedPlan().toString()
    # matches are summed where the postings are: only these are dealt
    assert plan.count("Exchange hashpartitioning(chunk_id") == 1 and "Exchange hashpartitioning(query_id" not in plan
    assert postings.scanned(postings.asked_tokens(queries, index), index).filter(F.col("score").isNull()).count() == 0
