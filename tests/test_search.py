import datetime
import decimal
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.functions.models import embed, overlap_model
from logloom.operators import blocks, clusters, retrieval
from logloom.operators.rerank import rerank
from logloom.plans.classify import answer, best_class, classify


def vectors(n, seed, prefix):
    rng = np.random.default_rng(seed)
    return [(f"{prefix}{i:03d}", [float(x) for x in rng.normal(size=5)]) for i in range(n)]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_dense_blocks_are_exact(spark, metric):
    left, right = vectors(30, 1, "q"), vectors(70, 2, "c")
    a = spark.createDataFrame(left, "query_id string, vector array<double>")
    b = spark.createDataFrame(right, "chunk_id string, vector array<double>")
    got = blocks.best_matches(a, b, "query_id", "chunk_id", blocks.dense_scorer(metric), 4, blocks=(3, 5)).collect()
    for name, v in left:
        x = np.array(v)
        scores = []
        for c, w in right:
            y = np.array(w)
            s = x @ y / math.sqrt((x @ x) * (y @ y)) if metric == "cosine" else -math.sqrt(((x - y) ** 2).sum())
            scores.append((-round(s, 6), c))
        want = [c for _, c in sorted(scores)[:4]]
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == name), key=lambda r: r["rank"])] == want


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the"] * 30 + ["logon", "failed", "process", "audit", "policy", "user", "handle", "object"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def bm25(queries, chunks):
    docs = {c: t.lower().split() for c, t in chunks}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for q, t in queries:
        for c, words in docs.items():
            s, met = 0.0, False
            for token in set(t.lower().split()):
                f = words.count(token)
                if f:
                    d = sum(token in w for w in docs.values())
                    met = True
                    s += math.log(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / avg))
            if met:
                out.setdefault(q, {})[c] = round(s, 6)
    return out


def test_bm25_and_hybrid_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    monkeypatch.setattr(blocks.block_count, "__defaults__", (40,))
    chunks = [(f"c{i:03d}", t) for i, t in enumerate(texts(150, 3))]
    queries = [(f"q{i:02d}", t) for i, t in enumerate(texts(12, 4))] + [("qx", "unknownword"), ("qy", "")]
    cv, qv = dict(vectors(150, 5, "c")), [v for _, v in vectors(len(queries), 6, "q")]
    a = spark.createDataFrame([(q, t, v) for (q, t), v in zip(queries, qv)], "query_id string, query string, vector array<double>")
    b = spark.createDataFrame([(c, t, cv[c]) for c, t in chunks], "chunk_id string, content string, vector array<double>")
    scores = bm25(queries, chunks)
    got = retrieval.search(a, b, "bm25", 3).collect()
    for q, _ in queries:
        want = sorted(scores.get(q, {}).items(), key=lambda e: (-e[1], e[0]))[:3]
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.chunk_id, pytest.approx(r.score)) for r in rows] == want

    # depth of the first pass is less than the number of chunks, so ranks beyond it are counted
    fused = retrieval.hybrid(a, b, 3, constant=5).collect()
    for (q, _), v in zip(queries, qv):
        x = np.array(v)
        cosine = {c: round(float(x @ np.array(w) / math.sqrt((x @ x) * (np.array(w) @ np.array(w)))), 6) for c, w in cv.items()}
        total = {}
        for ranking in (scores.get(q, {}), cosine):
            for place, (c, _) in enumerate(sorted(ranking.items(), key=lambda e: (-e[1], e[0])), 1):
                total[c] = total.get(c, 0) + 1 / (5 + place)
        want = sorted(((c, round(s, 6)) for c, s in total.items()), key=lambda e: (-e[1], e[0]))[:3]
        rows = sorted((r for r in fused if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.chunk_id, pytest.approx(r.score, abs=1e-6)) for r in rows] == want


def test_classify_and_answer(spark):
    chunks = embed(
        spark.createDataFrame(
            [("k1", "user logon success"), ("k2", "process started"), ("k3", "policy changed by user")],
            "chunk_id string, content string",
        ),
        "content",
        prompt="",
    )
    logs = spark.createDataFrame(
        [(1, "user logon"), (2, "user logon"), (3, ""), (4, None), (5, "process started now")],
        "log_id int, message string",
    )
    for search_type in ("bm25", "hybrid"):
        got = {r.log_id: r.class_chunk for r in best_class(classify(logs, chunks, 2, search_type)).collect()}
        assert got == {1: "k1", 2: "k1", 3: None, 4: None, 5: "k2"}
    queries = embed(spark.createDataFrame([("q", "process"), ("z", "nothing known")], "query_id string, query string"), "query")
    rows = {r.query_id: r for r in answer(queries, chunks, 2, "bm25").collect()}
    assert len(rows["q"].context) == 1 and rows["q"].context[0].startswith("process started [Score: ")
    assert rows["z"].context == [] and rows["z"].raw_results == []


def test_context_line_defaults(spark):
    row = spark.createDataFrame([(None, None)], "content string, score double").select(retrieval.context_line().alias("l")).first()
    assert row.l == " [Score: 0]"


def test_rerank_keeps_order_when_the_model_fails(spark):
    def broken():
        def score(pairs):
            if any(q == "bad" for q, _ in pairs):
                raise RuntimeError("no")
            return [len(c) for _, c in pairs]

        return score

    rows = [(q, q, f"c{i}", "x" * i, i) for q in ("bad", "good") for i in range(1, 6)]
    frame = spark.createDataFrame(rows, "query_id string, query string, chunk_id string, content string, rank int")
    got = rerank(frame, 3, broken).collect()
    by = lambda q: [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.new_rank)]
    assert by("bad") == ["c1", "c2", "c3"] and by("good") == ["c5", "c4", "c3"]
    assert all((r.cross_encoder_score is None) == (r.query_id == "bad") for r in got)
    assert rerank(frame, 3, overlap_model()).count() == 6


def test_embed_states(spark):
    def picky():
        def encode(batch):
            if any("boom" in t for t in batch):
                raise RuntimeError("no")
            return [[1.0, float(len(t))] for t in batch]

        return encode

    frame = spark.createDataFrame([("a",), ("",), ("boom",), (None,), ("  ",)], "t string")
    got = {r.t: (r.embed_status, r.vector) for r in embed(frame, "t", picky).collect()}
    assert got["a"] == ("OK", [1.0, float(len("Search for a"))])
    assert got[""] == got[None] == got["  "] == ("EMPTY", None)
    assert got["boom"] == ("ERROR", None)


def test_clusters_in_blocks_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(clusters, "POINT_BLOCK", 16)
    rng = np.random.default_rng(0)
    rows = []
    for label in range(3):
        for i in range(20):
            rows.append(("d", f"{label}-{i:02d}", [float(x) for x in rng.normal(size=3) * 0.1 + 10 * label]))
    rows += [("d", f"far{i}", [100.0 * (i + 2), 0.0, 0.0]) for i in range(3)]
    frame = spark.createDataFrame(rows, "dataset_id string, id string, vector array<double>")
    got = {r.id: (r.label, r.prob) for r in clusters.cluster(frame, min_size=10).collect()}
    assert {k: v[0] for k, v in got.items() if k.startswith("far")} == {"far0": None, "far1": None, "far2": None}
    for label in range(3):
        found = {got[f"{label}-{i:02d}"][0] for i in range(20)} - {None}
        assert len(found) == 1 and next(iter(found)).startswith(f"{label}-")
    assert all(0 <= p <= 1 for _, p in got.values())


def test_index_reads_what_may_reach_the_result(spark):
    """A few chunks share rare words with a query: only runs and postings about them are read."""
    from pyspark.sql import functions as F

    from logloom.operators import postings

    rng = random.Random(5)
    rows = [(i, f"common{j}", 0.1 + rng.random() / 10) for i in range(3000) for j in range(5)]
    rows += [(i, f"rare{i % 50}", 3.0 + i / 10_000) for i in range(0, 3000, 7)]
    index = postings.build(spark.createDataFrame(rows, "chunk_id int, token string, weight double"), run_chunks=16)
    asked = [(q, t, 1.0) for q in range(20) for t in [f"rare{q}", *(f"common{j}" for j in range(5))]]
    queries = spark.createDataFrame(asked, "query_id int, token string, weight double")
    held = {}
    for c, t, w in rows:
        held.setdefault(t, {})[c] = w
    got = {}
    for r in postings.best(queries, index, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
    for q in range(20):
        total = {}
        for t in [f"rare{q}", *(f"common{j}" for j in range(5))]:
            for c, w in held[t].items():
                total[c] = total.get(c, 0) + w
        want = sorted(((-round(s, 6), c) for c, s in total.items()))[:3]
        assert [(c, s) for _, c, s in sorted(got[q])] == [(c, -s) for s, c in want]
    known = postings.asked_tokens(queries, index)
    floors = postings.floors(known, index, 3)
    assert floors.count() == 20
    # the common words cannot decide: what is looked at are the chunks with the rare one
    met = postings.reaching(known, index, floors)
    assert met.count() < 0.05 * 20 * 3000
    assert met.join(floors, "query_id").filter(F.col("score") < F.col("floor") - 1e-5).count() == 0


def test_index_with_negative_weights_and_few_matches(spark):
    from logloom.operators import postings

    rows = [(1, "a", -1.0), (2, "a", 2.0), (2, "b", -3.0), (3, "b", 1.0), (4, "c", 0.0)]
    queries = [("q", "a", 1.0), ("q", "b", 2.0), ("z", "none", 1.0), ("c", "c", 5.0)]
    index = postings.build(spark.createDataFrame(rows, "chunk_id int, token string, weight double"), run_chunks=1)
    found = postings.best(spark.createDataFrame(queries, "query_id string, token string, weight double"), index, 5).collect()
    assert sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in found) == [
        ("c", 1, 4, 0.0), ("q", 1, 3, 2.0), ("q", 2, 1, -1.0), ("q", 3, 2, -4.0)
    ]


def test_cells_score_a_small_share_of_clustered_vectors(spark):
    from logloom.operators import cells

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 24))
    rows = [(i, (centres[i % 60] + rng.normal(size=24) * 0.15).tolist()) for i in range(6000)]
    rows += [(10_000, [0.0] * 24), (10_001, None), (10_002, [float("nan")] * 24)]
    queries = [(i, (centres[i % 60] + rng.normal(size=24) * 0.15).tolist()) for i in range(200)] + [(900, [0.0] * 24)]
    frame = spark.createDataFrame(rows, "chunk_id int, vector array<double>")
    asked = spark.createDataFrame(queries, "query_id int, vector array<double>")
    index = cells.build(frame)
    found = cells.best(asked, index, 5)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    x = np.array([v for _, v in rows[:6000]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ranks = {}
    for q, v in queries[:200]:
        score = np.round(x @ (np.array(v) / np.linalg.norm(v)), 6)
        order = np.lexsort([np.arange(6000), -score])
        ranks[q] = {int(c): n for n, c in enumerate(order, 1)}
        assert [c for _, c in sorted(got[q])] == order[:5].tolist()
    assert set(got) == set(range(200))
    assert cells.scored_pairs(asked, index, 5, found) < 200 * 6000 / 5
    # ranks far down are counted exactly, most cells whole
    wanted = [(q, c) for q in range(0, 200, 40) for c in (0, 17, 3000, 5999)]
    deep = cells.ranks_of(spark.createDataFrame(wanted, "query_id int, chunk_id int"), asked, index).collect()
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in deep) == sorted((q, c, ranks[q][c]) for q, c in wanted)


def test_search_plans_have_no_pairs_of_blocks(spark):
    chunks = spark.createDataFrame([("c1", "a b"), ("c2", "b c")], "chunk_id string, content string")
    asked = spark.createDataFrame([("q", "b")], "query_id string, query string")
    plan = retrieval.search(asked, chunks, "bm25", 2)._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "CoGroup" not in plan


def test_ranges_of_metadata(spark):
    day = datetime.datetime(2024, 5, 1)
    rows = [
        ("a", "10", "2024-05-01"), ("b", "9.5", "2024-05-01 00:00:01"), ("c", "100", "2024-04-30T23:59:59Z"), ("d", None, None), ("e", "ten", "soon"),
        ("f", "NaN", ""), ("g", "9007199254740993", "2024-05-02"), ("h", "-1e2", "2023-12-31"),
    ]
    frame = spark.createDataFrame(rows, "id string, n string, t string")

    def inside(column, **bounds):
        return "".join(r.id for r in frame.filter(retrieval.in_range(F.col(column), bounds)).orderBy("id").collect())

    assert inside("n", gte=10) == "acg" and inside("n", gt=10) == "cg" and inside("n", lt=10) == "bh" and inside("n", gt=9, lte=100) == "abc"
    assert inside("n", gte=9.5, lt=10.0) == "b" and inside("n", lte=float("inf")) == "abcgh"
    assert inside("n", gt=9007199254740992) == "g" and inside("n", gte=decimal.Decimal("9.5"), lte=decimal.Decimal("9.500000001")) == "b"
    assert inside("t", gte=day.date()) == "abg" and inside("t", gt=day) == "bg" and inside("t", lt=day) == "ch"
    assert inside("t", gte=day, lt=datetime.date(2024, 5, 2)) == "ab" and inside("t") == "abcdefgh"
    with pytest.raises(TypeError):
        retrieval.in_range(F.col("n"), {"gt": "10"})
    queries = spark.createDataFrame([("q", "logon")], "query_id string, query string")
    chunks = frame.select(F.col("id").alias("chunk_id"), F.lit("logon").alias("content"), F.create_map(F.lit("n"), F.col("n")).alias("metadata"))
    found = retrieval.search(queries, chunks, "bm25", 9, ranges={"n": {"gt": 9, "lt": 50}, "none": {}})
    assert sorted(r.chunk_id for r in found.collect()) == ["a", "b"]
