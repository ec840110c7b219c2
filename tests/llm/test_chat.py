import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import chat

SCHEMA = "tree_id long, msg_id long, parent_id long, role string, text string, score double, node string, leaf int, place int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2) for r in rows], SCHEMA)


def slow(rows):
    """Every root-to-leaf path by following parents."""
    by, out = {}, {}
    for t, m, p, role, text, score in sorted(rows, key=lambda r: [(x is not None, x) if x is not None else (False, 0) for x in (r[2], r[3] or "", r[4] or "", r[5] or 0.0)]):
        by.setdefault((t, m), (p, role or "", text or "", score or 0.0))
    parents = {(t, p) for (t, m), (p, *_) in by.items() if p is not None}
    for t, m in by:
        if (t, m) in parents:
            continue
        path, at, seen = [], m, set()
        while at is not None and (t, at) in by and at not in seen:
            seen.add(at)
            path.append(by[t, at])
            at = by[t, at][0]
        if at in seen:
            continue
        path.reverse()
        out[t, m] = ([(r, x) for _, r, x, _ in path], sum(s for *_, s in path) / len(path))
    return out


def test_random_trees(spark):
    random.seed(4)
    rows = []
    for tree in range(12):
        for m in range(random.randint(1, 40)):
            parent = random.choice([None, 999, *range(m)]) if m else None
            rows.append((tree, m, parent, random.choice(["user", "assistant", "a\nb\\"]), random.choice(["hi", "", None, "<|im_end|>", "x\n<\\|"]), random.choice([None, 0.5, 1.0, 2.0])))
    done = chat.conversations(frame(spark, rows)).collect()
    expected = slow(rows)
    assert len(done) == len(expected)
    for r in done:
        turns, score = expected[r.tree_id, r.leaf_id]
        assert chat.parse(r.formatted) == turns and r.n_turns == len(turns)
        assert abs(r.score - score) < 1e-9
        loss = [chat.unescaped(r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert loss == [x for role, x in turns if role == "assistant"]
    for tree in range(12):
        mine = sorted((r for r in done if r.tree_id == tree), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r.leaf_id for r in mine] == [r.leaf_id for r in sorted(mine, key=lambda r: (-r.score, r.leaf_id))]
    best = chat.conversations(frame(spark, rows), top=2).collect()
    assert {(r.tree_id, r.leaf_id) for r in best} == {(r.tree_id, r.leaf_id) for r in done if r["rank"] <= 2}


def test_deep_chain_takes_few_rounds(spark):
    rows = [(1, m, m - 1 if m else None, "user" if m % 2 == 0 else "assistant", str(m), 0.0) for m in range(300)]
    trees = chat.reply_trees(frame(spark, rows))
    sums, jumps = chat.ancestors(trees)
    assert len(jumps) == 9 and sums.count() == 300
    (one,) = chat.conversations(frame(spark, rows)).collect()
    assert [t for _, t in chat.parse(one.formatted)] == [str(m) for m in range(300)]


def test_odd_rows(spark):
    long = "<|im_end|>" * 30_000
    rows = [
        (None, None, None, "user", "tree and message without an id", 0.0),
        (1, 1, 2, "user", "on a cycle", 0.0), (1, 2, 1, "user", "on a cycle", 0.0), (1, 3, 2, "user", "behind it", 0.0),
        (2, 1, None, "user", long, 0.0), (2, 2, 1, "assistant", long, 0.0), (2, 2, 1, "assistant", long, 0.0),
        (3, 1, 1, "user", "its own parent", 0.0), (4, 1, 77, None, None, None),
    ]
    done = {(r.tree_id, r.leaf_id): r for r in chat.conversations(frame(spark, rows)).collect()}
    assert set(done) == {(None, None), (2, 2), (4, 1)}
    assert chat.parse(done[2, 2].formatted) == [("user", long), ("assistant", long)]
    assert chat.parse(done[4, 1].formatted) == [("", "")]


def test_empty_table(spark):
    assert chat.conversations(frame(spark, [])).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="us\\n\n<|>", max_size=6), st.text(alphabet="<|\\>im_end\nx", max_size=12)), max_size=4))
def test_escapes_are_reversible(turns):
    import re

    esc = lambda t: re.sub(r"<(\\*)\|", r"<\1\\|", t)
    line = lambda r: esc(r.replace("\\", "\\\\").replace("\n", "\\n"))
    formatted = "".join(f"{chat.START}{line(r)}\n{esc(t)}{chat.END}\n" for r, t in turns)
    assert chat.parse(formatted) == turns


def test_spark_escapes_as_python_does(spark):
    texts = ["<|", "<\\|", "<\\\\|x", "a<b|c", "<<||", "\\<|\\"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).collect()
    for r in rows:
        assert "<|" not in r.e and chat.unescaped(r.e) == r.t


def test_digests(spark):
    rows = [(1, 0, None, "user", "é", 0.0), (1, 1, 0, "assistant", "<|x|>ü", 0.0)]
    done = chat.conversations(frame(spark, rows)).select(chat.digests(F.col("formatted"), F.col("loss_spans")).alias("d")).first().d
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (done.n_turns, done.turns_sha256, done.loss_chars, done.loss_sha256) == (2, sha("user\né\nassistant\n<|x|>ü\n"), 6, sha("<|x|>ü"))
