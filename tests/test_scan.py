"""Few queries over chunks whose tokens are counted, scored and ranked where their text is."""

import random

from logloom.operators import postings, retrieval

WORDS = [f"w{i}" for i in range(30)]


def data(spark, repeated):
    rng = random.Random(3)
    chunks = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for i in range(200)] + [(200, None), (201, "  ")]
    if repeated:
        # a chunk twice as it is, one with another text as long, one with a longer text, two without an id
        chunks += [chunks[5], (6, " ".join(reversed(WORDS[: len(chunks[6][1].split())]))), (7, " ".join(WORDS)), (None, "w1 w2"), (None, "w2 w1")]
    asked = [(q, " ".join(rng.choices([*WORDS, "none"], k=4))) for q in range(12)]
    return spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame(chunks, "chunk_id int, content string")


def rows(found):
    return sorted(((r.query_id, r["rank"], r.chunk_id, r.score) for r in found.collect()), key=str)


def test_few_queries_take_no_postings(spark, monkeypatch):
    def none(*_):
        raise AssertionError("postings are looked up")

    for repeated in (False, True):
        queries, chunks = data(spark, repeated)
        with monkeypatch.context() as m:
            m.setattr(postings, "asked_tokens", none)
            m.setattr(postings, "SCAN_CELLS", 200, raising=False)  # some chunks at a time
            scanned = rows(retrieval.lexical(queries, chunks, 5))
        with monkeypatch.context() as m:
            m.setattr(postings, "SCAN_TOKENS", 0)
            assert rows(retrieval.lexical(queries, chunks, 5)) == scanned
        if not repeated:
            _, index = retrieval.bm25_weights(queries, chunks)
            assert "Exchange hashpartitioning(chunk_id" not in index.lists._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_counted_without_rows_of_all_matches(spark, monkeypatch):
    queries, chunks = data(spark, False)
    words, index = retrieval.bm25_weights(queries, chunks)
    full = postings.best(words, index, 1000).collect()
    wanted = [(r.query_id, r.chunk_id) for r in full if r["rank"] in (1, 2, 30, 31, 60)] + [(0, 201)]
    given, scanned = [], postings.scanned

    def spied(queries, index, lists=None):
        given.append(lists.count())
        return scanned(queries, index, lists)

    monkeypatch.setattr(postings, "scanned", spied)
    got = postings.ranks_of(spark.createDataFrame(wanted, "query_id int, chunk_id int"), words, index).collect()
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got) == sorted(
        (r.query_id, r.chunk_id, r["rank"]) for r in full if (r.query_id, r.chunk_id) in wanted
    )
    assert given == [len({c for _, c in wanted})]
