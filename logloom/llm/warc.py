"""WARC archives, each record a Zstandard frame of its own under a shared dictionary.

The dictionary is trained on a bounded sample of the records and stands, as the
.warc.zst convention has it, in a skippable frame at the head of every archive.
Tasks write archives into a shared folder under names of their attempt; the
manifest they return lists the archives of those attempts that count.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import small_if_measured
from logloom.session import cut_lineage, shuffle_width

LEAST_REVISIT = 1000
DICTIONARY = 64 << 10
LEVEL = 3
# Bounds of the dictionary sample: records, and characters of each payload that are in it
SAMPLE = 400
SAMPLE_CHARS = 16 << 10
# Bytes after which an archive is closed and the next begun
ROLL = 64 << 20
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def places(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) with size, digest, keeper and keeper_url.

    Of equal payloads of ``least`` bytes or more the row with the largest page_id
    is the keeper, for the others to refer to; a row that repeats that very id is
    a response too. Null ids refer to a keeper but are none, unless alone.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", "url", payload.alias("html"), F.octet_length(payload).cast("bigint").alias("size"), F.sha1(payload.cast("binary")).alias("digest")
    )
    shared = cut_lineage(
        rows.filter(F.col("size") >= least)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("keeper"), F.max_by("url", F.struct("page_id", "url")).alias("keeper_url"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and keeper is not null")
        .drop("n")
    )
    width = F.octet_length(F.coalesce("keeper_url", F.lit(""))) + 80
    return rows.join(small_if_measured(shared, width), ["digest", "size"], "left")


def record(page_id, url, payload: bytes, digest: str, keeper, keeper_url, date: str) -> bytes:
    """One WARC/1.1 record; a revisit where a ``keeper`` other than the page is given."""
    revisit = keeper is not None and keeper != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {one_line(url)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(keeper)}", f"WARC-Refers-To-Date: {date}"]
        if keeper_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {one_line(keeper_url)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def one_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def drawn(rows: DataFrame, n: int = SAMPLE) -> DataFrame:
    """(digest): ``n`` distinct digests of ``rows``, or all if they are fewer.

    Digests that a hash rate lets through, about four times ``n`` whatever the
    number of rows, copies or partitions is, are all that is shuffled.
    """
    marks = rows.select("digest")
    distinct = marks.agg(F.approx_count_distinct("digest")).first()[0]
    place = F.pmod(F.xxhash64("digest"), F.lit(1 << 30))
    some = marks.filter(place < F.lit(int(min(1.0, 4 * n / max(1, distinct)) * (1 << 30)))).distinct()
    return some.orderBy(place, "digest").limit(n)


def dictionary(rows: DataFrame, date: str) -> bytes:
    """A dictionary of up to ``SAMPLE`` records of distinct payloads; empty if they are too few to train on.

    Of a payload the first ``SAMPLE_CHARS`` characters are used, which bounds what
    the driver takes in, whatever the records and partitions are.
    """
    chosen = cut_lineage(drawn(rows))
    # at most SAMPLE digests, so small enough to broadcast; copies are merged before they move
    records = (
        rows.select("page_id", "url", F.substring("html", 1, SAMPLE_CHARS).alias("html"), "digest")
        .join(F.broadcast(chosen), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.first("html").alias("html"), F.min("page_id").alias("page_id"), F.min("url").alias("url"))
        .collect()
    )
    samples = [record(r.page_id, r.url, r.html.encode("utf-8", "surrogatepass"), r.digest, None, None, date) for r in records]
    samples.sort()
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(pages: DataFrame, folder: str, date: str, least: int = LEAST_REVISIT, roll: int = ROLL) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html) into ``folder``; the manifest (path, records, bytes).

    Null html is an empty payload, null urls are left out of the record. The
    folder must be shared by all executors and of a scheme that pyarrow knows. A
    task that runs again writes new archives; only those the manifest names count.
    No rows, no archives. Where records are too few to train a dictionary on, frames go
    without; the manifest says so, its ``dictionary`` is the size of it in bytes.
    """
    rows = places(pages, least)
    content = dictionary(rows, date)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{root.rstrip('/')}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        shared = zstandard.ZstdCompressionDict(content) if content else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
        out, path, done, size, count = None, "", [], 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, keeper, keeper_url = (batch.column(c)[i].as_py() for c in range(6))
                if out is None:
                    path, size, count = f"{name}-{len(done):05d}.warc.zst", 0, 0
                    out = store.open_output_stream(path, compression=None)
                    if content:
                        size += out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
                size += out.write(
                    squeeze.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, keeper, keeper_url, date))
                )
                count += 1
                if size >= roll:
                    out.close()
                    done, out = [*done, (path, count, size)], None
        if out is not None:
            out.close()
            done.append((path, count, size))
        paths = [f"{folder.rstrip('/')}/{p.rpartition('/')[2]}" for p, _, _ in done]
        yield pa.RecordBatch.from_pydict(
            {"path": paths, "records": [n for _, n, _ in done], "bytes": [s for _, _, s in done], "dictionary": [len(content)] * len(done)},
            schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("dictionary", pa.int64())]),
        )

    chosen = rows.select("page_id", "url", "html", "digest", "keeper", "keeper_url")
    return cut_lineage(chosen.mapInArrow(archive, "path string, records long, bytes long, dictionary long"))


def records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of one archive, read frame after frame."""
    head = stream.read(8)
    shared = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        shared = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
        head = b""
    plain = zstandard.ZstdDecompressor(dict_data=shared).stream_reader(Prefixed(head, stream), read_across_frames=True)
    lines = io.BufferedReader(plain)
    while line := lines.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record at {line[:20]!r}")
        headers = {}
        while (line := lines.readline()) != b"\r\n":
            key, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            headers[key] = value
        block = lines.read(int(headers["Content-Length"]))
        lines.read(4)
        yield headers, block


class Prefixed(io.RawIOBase):
    """A stream after bytes that were read from it already."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        piece = self.head or self.rest.read(len(buffer))
        self.head = piece[len(buffer) :]
        piece = piece[: len(buffer)]
        buffer[: len(piece)] = piece
        return len(piece)


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the archives listed.

    Digest and size of a response are those of the payload read, which must
    match its header; those of a revisit are what its headers say of the payload.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_stream(place, compression=None) as stream:
                    for headers, block in records(stream):
                        rows.append(parsed(headers, block))
                        if len(rows) == 5000:
                            yield as_batch(rows)
                            rows = []
                yield as_batch(rows)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def as_batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    width = max(1, min(manifest.count(), shuffle_width(manifest.sparkSession)))
    return (
        manifest.select("path")
        .repartition(width)
        .mapInArrow(
            parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
        )
    )


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    kind = headers["WARC-Type"]
    if kind == "response":
        found = hashlib.sha1(payload).hexdigest()
        if (found, len(payload)) != (digest, size):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its headers")
    refers_to = page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
    return page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, digest, kind, refers_to
