import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import decontaminate, queries
from logloom.llm.common import table
from tests.compare import canonical, connect

SF = "/root/testdata/sf0.001"
PRIMES = "doc_id long, text string, lang string, source string, n_chars long, ids int, found int, cuts int, row_key int, id int"


@pytest.mark.parametrize("name", sorted(queries.ENTRIES))
def test_registered_queries_return_every_row(spark, name):
    run, sql = queries.ENTRIES[name]
    frame = run(spark, SF)
    rows = frame.collect()
    tables = {"op1": "conversations", "op6": "embeddings", "op10": "pages"}
    if sql:
        cursor = connect(SF).execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(frame.columns)
        assert canonical(names, cursor.fetchall()) == canonical(frame.columns, [tuple(r) for r in rows])
    if name.startswith("op7"):
        assert rows and sql is None
        return
    if name.startswith(("op12", "op13")):
        # phrases and words, not documents
        assert rows
        return
    source = table(spark, SF, tables.get(name.split("_")[0], "documents"))
    want = source.select("conv_id").distinct().count() + 1 if name.startswith("op1_") else source.count()
    assert len(rows) == want


def test_digests_of_all_conversations(spark):
    rows = table(spark, SF, "conversations").orderBy("conv_id", "turn").collect()
    by = {-1: [("user", queries.PLANTED_TEXT), ("assistant", queries.PLANTED_TEXT)]}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op1_chat_format(spark, SF).collect():
        turns = by[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        kept[name] = after.cache()
        if name != "sentencepiece":
            assert after.columns == docs.columns
        assert after.count() <= before.count()
        before = kept[name]
    last = kept["sentencepiece"].collect()
    assert last and all(r.exact and r.n_ids == len(r.ids) for r in last)
    # clean documents stay, and nothing of the benchmark or of secrets is left
    assert kept["language_id"].count() >= 0.97 * docs.count()
    left = kept["benchmark_decontamination"]
    assert decontaminate.passages(left, table(spark, SF, "benchmark")).count() == 0
    found = re.compile(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}|(?i:password|token) ?= ?\"?[0-9a-f]{6,}")
    assert not [r for r in last if found.search(r.text)]
    assert all(r.n_chars == len(r.text) for r in last)
    for frame in kept.values():
        frame.unpersist()


def test_stages_on_odd_rows(spark):
    text = "the of and to in is that it for was on are with as at this from by have be"
    rows = [(1, None), (2, ""), (3, "123"), (4, text), (5, text.upper()), (5, text.upper()), (None, text), (7, text + " token=abcdefgh more")]
    frame = spark.createDataFrame([(i, t, None, None, 7, 1, 2, 3, 4, 5) for i, t in rows], PRIMES)
    docs = frame
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name == "language_id":
            assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 4, 5, 5, 7]
        if name == "simhash_near_dedup":
            assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 4, 7]
    out = docs.collect()
    assert {r.doc_id for r in out} == {None, 4, 7} and set(frame.columns) <= set(docs.columns)
    assert [r.text for r in out if r.doc_id == 7] == [f"{text} [REDACTED] more"]


def test_near_copies_keep_one_row_of_each_group_where_ids_repeat(spark):
    a, b = ("the of and to in is that it for was on are with as at this from by have be", "der die und das in ist nicht ein von zu mit auf")
    c = "la de que el en y a los se del las un por con"
    # 2: a copy of 1 and a text of its own; 1: three times, once another text; 3 and 4: copies of that one
    rows = [(1, a), (1, a), (2, a.upper()), (2, b), (1, c), (3, c), (4, c)]
    frame = spark.createDataFrame([(i, t, None, None, 7, 1, 2, 3, 4, 5) for i, t in rows], PRIMES)
    done = corpus_pipeline.near_copies(spark, frame, SF)
    assert done.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in done.collect()) == sorted([(1, a), (1, c), (2, b)])


def test_stages_on_no_rows(spark):
    docs = spark.createDataFrame([], PRIMES)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_run_is_the_stages(spark):
    done = corpus_pipeline.run(spark, SF)
    assert done.select(F.count(F.lit(1))).first()[0] > 0 and "ids" in done.columns
