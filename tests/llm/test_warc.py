import hashlib
import io
import os
import struct

import zstandard

from logloom.llm import common, warc
from logloom.llm.common import table
from logloom.session import scratch_path

SCHEMA = "page_id long, url string, html string, size string, digest int, keeper string"
DATE = "2024-01-01T00:00:00Z"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "k") for r in rows], SCHEMA)


def slow(rows, least=1000):
    keep = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= least and i is not None:
            keep[raw] = max(i, keep.get(raw, i))
    out = []
    for i, u, h in rows:
        raw = (h or "").encode()
        k = keep.get(raw)
        revisit = k is not None and k != i
        out.append((i, u, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", k if revisit else None))
    return out


def round_trip(spark, pages, **kw):
    manifest = warc.write(pages, scratch_path(spark, "warc-test"), DATE, **kw)
    return manifest, sorted(map(tuple, warc.read(manifest).collect()), key=repr)


def odd_rows():
    big = "<p>" + "same words again " * 100
    return [
        (1, "http://a/", big), (2, "http://b/", big), (9, "http://c/", big), (9, "http://c/", big), (None, "http://d/", big), (None, None, big + "!"),
        (3, None, None), (4, "http://e/\r\nX: y", ""), (5, "ü", "x" * 999), (6, "ü", "x" * 999), (7, "u", "é" * 500), (8, "u", "é" * 500),
        (10, "long", "word é\r\n\r\nWARC/1.1\r\n " * 60_000), (-11, "neg", "y"),
    ]


def test_odd_rows_come_back(spark):
    rows = odd_rows()
    manifest, got = round_trip(spark, frame(spark, rows))
    want = [(i, u.replace("\r", "%0D").replace("\n", "%0A") if u else u, *rest) for i, u, *rest in slow(rows)]
    assert got == sorted(want, key=repr)
    assert manifest.groupBy().sum("records").first()[0] == len(rows)


def test_by_shuffle_and_in_small_archives(spark, monkeypatch):
    rows = odd_rows() + [(100 + i, "http://x/", f"<html>{i % 7} {'body text ' * 200}") for i in range(200)]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    manifest, got = round_trip(spark, frame(spark, rows), roll=2000)
    assert manifest.count() > 10
    want = [(i, u.replace("\r", "%0D").replace("\n", "%0A") if u else u, *rest) for i, u, *rest in slow(rows)]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    manifest, got = round_trip(spark, frame(spark, []))
    assert got == [] and manifest.collect() == []


def test_layout_of_an_archive(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    manifest, got = round_trip(spark, pages)
    assert got == sorted(slow([tuple(r) for r in pages.select("page_id", "url", "html").collect()]), key=repr)
    path = manifest.first().path.removeprefix("file://")
    with open(path, "rb") as f:
        raw = f.read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and 0 < size <= warc.DICTIONARY
    shared = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    # a record a frame: the first frame is one whole record
    one = zstandard.ZstdDecompressor(dict_data=shared).decompressobj().decompress(raw[8 + size :])
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: ") and one.endswith(b"\r\n\r\n") and one.count(b"WARC-Record-ID") == 1
    whole = list(warc.records(io.BytesIO(raw)))
    assert len(whole) == manifest.first().records
    plain = sum(len(zstandard.compress(b)) for _, b in whole)
    assert len(raw) - size < plain and os.path.getsize(path) == manifest.first().bytes


def sample_of(spark, pages, parts):
    return {r.digest for r in warc.drawn(warc.places(pages.repartition(parts)), 400).collect()}


def test_dictionary_is_drawn_from_distinct_records_whatever_the_partitions(spark):
    body = lambda i: f"<html><title>{i}</title>" + " ".join(f"word{(i * 7 + j) % 5000}" for j in range(120))
    rows = [(i, f"http://x/{i}", body(i)) for i in range(3000)]
    least = min(rows, key=lambda r: hashlib.sha1(r[2].encode()).hexdigest())
    rows += [(10_000 + i, "http://copy/", least[2]) for i in range(2000)]
    rows += [(50_000 + i, "http://long/", body(i) + "z" * 70_000) for i in range(30)]
    pages = frame(spark, rows)
    few, many = sample_of(spark, pages, 4), sample_of(spark, pages, 64)
    assert few == many and len(few) == 400
    # as many long records as their share, cut to pieces
    content = warc.dictionary(warc.places(pages), DATE)
    assert len(content) == warc.DICTIONARY
    only_long = frame(spark, rows[-30:])
    assert len(warc.dictionary(warc.places(only_long), DATE)) > 0
    manifest = warc.write(only_long, scratch_path(spark, "warc-test"), DATE)
    assert all(r.dictionary > 0 for r in manifest.collect())


def test_manifest_says_where_there_is_no_dictionary(spark):
    manifest, got = round_trip(spark, frame(spark, [(1, "u", "x" * 2000), (2, "u", "y")]))
    assert [r.dictionary for r in manifest.collect()] == [0] * manifest.count() and len(got) == 2
