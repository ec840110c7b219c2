import json
import random

import pytest

from logloom.sources import catalogue
from logloom.sources.members import members

STRINGS = ["", "a,b", ',"', "\\", '\\",[', "]}", "{", "x\ny", "é,ü", "attributes", '"attributes":{', ",,", "a\\\\,"]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return rng.choice(STRINGS)
    if kind < 4:
        return rng.choice([None, True, 0, -1.5, 10**12])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"{rng.choice(STRINGS)}{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}


def document(rng, n):
    many = [{"name": f"c{i}", "v": value(rng)} for i in range(rng.randrange(6))]
    named = {f"k,{i}\"": m for i, m in enumerate(many)}
    body = [many, {"attributes": named}, {"attributes": many}, {"v": 1, "x": {"attributes": 3}, "attributes": named, "w": [1]}, {"name": f"single{n}", "v": value(rng)}][n % 5]
    return json.dumps(body, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)


def plain(found):
    return sorted((r.path, r.pos.place, r.key, r.json and json.dumps(json.loads(r.json))) for r in found.collect())


def plain_text(found):
    return [(r.pos.place, r.key, r.json) for r in found.collect()]


@pytest.mark.parametrize("split", ["64", "128m"])
def test_members_equal_those_of_whole_documents(spark, tmp_path, split):
    """Documents with all that looks like structure in their strings, whole and cut into splits of 64 bytes."""
    rng = random.Random(11)
    for n in range(30):
        (tmp_path / f"d{n:02d}.json").write_text(document(rng, n))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "8k")
        got = plain(members(spark, str(tmp_path)))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    want = plain(catalogue.entries(catalogue.documents(spark, str(tmp_path))))
    assert len(want) > 50 and got == want


def test_odd_documents(spark, tmp_path):
    texts = {"empty.json": "", "list.json": " [ ] ", "none.json": '{"attributes": { }}', "open.json": '[{"a":1},{"b":2}', "quote.json": '["a]'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "scalars.json").write_text('["a,b", 1 ,null,[2,3]]')
    assert plain_text(members(spark, str(tmp_path)).orderBy("pos")) == [
        (0, None, "a,b"), (1, None, "1"), (2, None, None), (3, None, "[2,3]"),
    ]
    # no list, so an entry by itself
    (tmp_path / "closed").mkdir()
    (tmp_path / "closed" / "c.json").write_text("][")
    assert plain_text(members(spark, str(tmp_path / "closed"))) == plain_text(catalogue.entries(catalogue.documents(spark, str(tmp_path / "closed")))) == [(0, None, "][")]
    with_nothing = tmp_path / "nothing"
    with_nothing.mkdir()
    (with_nothing / "e.json").write_text("")
    assert members(spark, str(with_nothing)).count() == 0


def test_no_row_holds_a_document(spark, tmp_path):
    """A document of one long list: split, and no record longer than what is between two commas."""
    from logloom.sources.members import records

    (tmp_path / "long.json").write_text("[" + ",".join(f'{{"name":"c{i}","v":[{i},{i}]}}' for i in range(20_000)) + "]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        rows = records(spark, str(tmp_path))
        longest, blocks = rows.selectExpr("max(length(text))", "count(DISTINCT block)").first()
        found = members(spark, str(tmp_path)).selectExpr("count(*)", "sum(pos.place)", "max(json)").first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert longest < 40 and blocks > 5
    assert tuple(found) == (20_000, 20_000 * 19_999 // 2, '{"name":"c9999","v":[9999,9999]}')


@pytest.mark.parametrize("size", [1, 40, 700])
def test_members_of_slices_of_any_size(spark, tmp_path, monkeypatch, size):
    """Members, entries by themselves and brackets at the ends of slices."""
    from logloom.sources import members as m

    rng = random.Random(size)
    for n in range(30):
        (tmp_path / f"d{n:02d}.json").write_text(document(rng, n))
    (tmp_path / "entry.json").write_text(json.dumps({"name": "z,a", "v": [1, {"b": 2}, [3, 4]]}, indent=1))
    monkeypatch.setattr(m, "SLICE", size)
    monkeypatch.setattr(m, "FEW", 3)
    monkeypatch.setattr(m, "BATCH", 10)
    want = plain(catalogue.entries(catalogue.documents(spark, str(tmp_path))))
    assert len(want) > 50 and plain(members(spark, str(tmp_path))) == want


def test_rows_are_kept_by_slice_not_by_comma(spark, tmp_path, monkeypatch):
    """What is materialised on the way grows with the bytes, not with the commas."""
    from logloom.sources import members as m

    (tmp_path / "long.json").write_text("[" + ",".join(f'{{"name":"c{i}","v":[{i},{i}]}}' for i in range(20_000)) + "]")
    kept = []

    def counting(frame, cut=m.cut_lineage):
        frame = cut(frame)
        kept.append(frame.count())
        return frame

    monkeypatch.setattr(m, "cut_lineage", counting)
    assert members(spark, str(tmp_path)).count() == 20_000
    assert sum(kept) < 1_000
