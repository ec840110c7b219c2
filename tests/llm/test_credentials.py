import random
import re

from logloom.llm import credentials as cr

SCHEMA = "doc_id long, text string, key string, kind string, spans int, cuts int, row_key int"
BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20),
    "hex": (re.compile(r"[0-9a-f]+"), 24),
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "x", 1, 2, 3) for i, t in rows], SCHEMA)


def slow_base(text):
    out = []
    for place, (kind, (pattern, least)) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), place, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def found(spark, rows):
    lists = cr.listed(cr.spans(frame(spark, rows))).collect()
    return {(r.key.id, r.key.n): [(s.kind, s.start, s.end) for s in r.spans] for r in lists}


def pieces(rng):
    hexes = "".join(rng.choices("0123456789abcdef", k=rng.choice([10, 23, 24, 40])))
    return rng.choice([
        f"password={hexes}", "PassWD : 'x.y=z'", "token=tok", "password=token: abcdefgh", "api_key==abcdef", "apikey\": \"abc/def+9",
        "AKIA" + "A" * rng.choice([10, 15, 16, 30]), "AKIAAKIA" + "Z9" * 8, hexes, "secret = ", "é\U0001f600 ", "word ", "\n\n", "token token=", "s3cret",
    ])


def test_base_spans_against_python(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(pieces(rng) for _ in range(rng.randrange(12)))) for i in range(300)]
    rows += [(1000 + i, "".join(pieces(rng) for _ in range(rng.randrange(12)))) for i in range(300)]
    got = found(spark, rows)
    for i, text in rows:
        base = [s for s in got.get((i, len(text)), []) if s[0] in cr.STRONG]
        assert base == slow_base(text), text


def slow_linked(spans, scope):
    """The weak spans whose complements are near, by all pairs."""
    out = []
    for kind, a, b in spans:
        if kind in cr.STRONG:
            continue
        near = {cr.PART[k] for k, s, e in spans if s <= b + scope and e >= a - scope}
        need = {"who": {"what"}, "what": {"who"}, "where": {"who", "what"}}[cr.PART[kind]]
        if need <= near:
            out.append((kind, a, b))
    return out


def test_linking_against_all_pairs(spark):
    rng = random.Random(5)
    key = "Zx9" + "aB3dE6gH" * 3
    words = ["login=anna.k", "AKIA" + "Q" * 16, key, "https://db.example.com/x", "password=hunter22", "lorem ipsum " * 8, "dolor\n" * 30]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 14)))) for i in range(150)]
    docs = frame(spark, rows)
    every = cr.matches(docs, "doc_id", "text", {**cr.STRONG, **cr.WEAK}).collect()
    by = {}
    for r in every:
        by.setdefault(r.key.id, []).append((r.kind, r.start, r.end))
    got = found(spark, rows)
    some = 0
    for i, text in rows:
        weak = sorted(s for s in got.get((i, len(text)), []) if s[0] in cr.WEAK)
        assert weak == sorted(slow_linked(by.get(i, []), cr.SCOPE)), text
        some += len(weak)
    assert some > 50


def test_weak_parts_alone_are_not_reported(spark):
    key = "Zx9" + "aB3dE6gH" * 3
    rows = [(1, f"see {key} there"), (2, "https://a.example.com/x"), (3, "login=anna"), (4, f"login=anna {'word ' * 100} {key}"), (5, f"login=anna {key}")]
    got = found(spark, rows)
    assert set(i for i, _ in got) == {5} and {k for k, *_ in got[5, len(rows[4][1])]} == {"identifier", "key"}


def test_odd_rows_and_redaction(spark):
    long = "x y " * 30_000 + "password=abcdef0123 " * 2000
    rows = [(1, None), (2, ""), (3, "clean"), (4, "a password=0123456789abcdef01234567 b"), (4, "a password=0123456789abcdef01234567 b"), (4, "token=abcdefg"), (None, "é\U0001f600 token=abcdefg."), (7, long)]
    docs = frame(spark, rows)
    clean = cr.redacted(docs, cr.spans(docs))
    assert clean.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text) for r in clean.collect()), key=repr)
    mark = cr.REDACTED
    want = [(1, None), (2, ""), (3, "clean"), (4, f"a {mark} b"), (4, f"a {mark} b"), (4, mark), (0, f"é\U0001f600 {mark}"), (7, "x y " * 30_000 + f"{mark} " * 2000)]
    assert got == sorted(want, key=repr)


def test_redaction_by_shuffle_is_the_same(spark, monkeypatch):
    from logloom.llm import common

    docs = frame(spark, [(i, f"row {i} token=abcdefg{i}") for i in range(20)])
    one = sorted(r.text for r in cr.redacted(docs, cr.spans(docs)).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert one == sorted(r.text for r in cr.redacted(docs, cr.spans(docs)).collect()) == sorted(f"row {i} {cr.REDACTED}" for i in range(20))


def test_empty_table(spark):
    docs = frame(spark, [])
    assert cr.spans(docs).collect() == [] and cr.redacted(docs, cr.spans(docs)).collect() == []


def test_no_python_in_the_plan(spark):
    docs = frame(spark, [(1, "token=abcdefg")])
    plan = cr.listed(cr.spans(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
