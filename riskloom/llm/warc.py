"""WARC archives in seekable Zstandard bundles.

``write_bundles`` turns a page table into bundles of about ``BUNDLE`` bytes.  Records are grouped into independent Zstandard
frames of about ``FRAME`` plain bytes (a longer record is a frame of its own), and a skippable footer frame holds the seek
table (compressed and plain size of every frame).  While a bundle is written its index grows beside it: for each record its
identifier, frame, offset within the frame and length.  So a record is read by one ranged read of a frame and one small
decompression (``fetch``), and ``read_bundles`` reads everything that way: by the index and the footer.

Records with equal payloads of at least ``LEAST`` bytes are written once: the row with the largest page_id is the response,
the others are revisits of it; smaller ones are all responses.  Bundles and their index are rows of a table, written by
Spark to the shared folder, so any file system Spark knows will do; ``index_bundles`` is the index alone.

Edge cases: a null html is an empty payload.  A null page_id gets a record of its own and is never referred to.
Equal rows are both responses if theirs is the largest page_id.  An empty table gives no bundle and an empty
result.  Records stand in a bundle in the order in which they reach its task; no result depends on it.  A very long payload
is one record, frame and bundle of its own size.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import cut, join_groups, tune

LEAST = 1000
FRAME, BUNDLE = 256 << 10, 4 << 20
LEVEL = 3
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
BUNDLES = "bundle string, records long, data binary, places array<struct<page_id:long,frame:int,start:long,length:long>>"
PLACES = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("truncated WARC record")
    return headers, block.partition(b"\r\n\r\n")[2]


def sealed(frames: list[bytes], sizes: list[int]) -> bytes:
    """Frames with the seek table behind them."""
    table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(frames, sizes, strict=True)) + struct.pack("<IBI", len(frames), 0, FOOTER)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the footer alone."""
    n, descriptor, magic = struct.unpack("<IBI", data[-9:])
    each = 12 if descriptor & 0x80 else 8
    start = len(data) - 9 - n * each
    if magic != FOOTER or struct.unpack("<II", data[start - 8 : start]) != (SKIPPABLE, n * each + 9):
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        size, plain = struct.unpack("<II", data[start + i * each : start + i * each + 8])
        out.append((at, size, plain))
        at += size
    return out


def _page(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def write_bundles(pages: DataFrame, least: int = LEAST, bundle: int = BUNDLE, frame: int = FRAME) -> DataFrame:
    """The written bundles (bundle, records, data, places) of pages (page_id, url, html)."""
    tune(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digest = F.sha1(F.col("html").cast("binary")).alias("digest")
    ids = cut(pages.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", digest), "digests")
    first = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = join_groups(ids, first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    pages = pages.select("page_id", "url", "html", digest)
    todo = pages.where(F.col("page_id").isNotNull()).join(revisits.hint("merge"), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    todo = todo.unionAll(pages.where(F.col("page_id").isNull()).withColumn("refers_to", F.lit(None).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        frames, sizes, places, held = [], [], [], []

        def close() -> None:
            if held:
                plain = b"".join(held)
                frames.append(compress(plain))
                sizes.append(len(plain))
                held.clear()

        def seal() -> pa.RecordBatch:
            close()
            data = sealed(frames, sizes)
            name = f"{TaskContext.get().partitionId():06d}-{uuid.UUID(bytes=hashlib.md5(data).digest())}"
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(places)], pa.int64()), pa.array([data], pa.binary()), pa.array([places], PLACES)], ["bundle", "records", "data", "places"])
            for x in (frames, sizes, places):
                x.clear()
            return out

        inside, total = 0, 0
        for b in batches:
            for page_id, url, text, sha, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = record(page_id, url, text.encode(), sha, refers_to)
                if inside and inside + len(raw) > frame:
                    close()
                    inside = 0
                places.append({"page_id": page_id, "frame": len(frames), "start": inside, "length": len(raw)})
                held.append(raw)
                inside += len(raw)
                total += len(raw)
                if total >= bundle:
                    yield seal()
                    inside = total = 0
        if places:
            yield seal()

    return cut(todo.mapInArrow(K.lean(run), BUNDLES), "warc")


def index_bundles(bundles: DataFrame) -> DataFrame:
    """page_id, bundle, frame, start (within the plain frame), length of every record."""
    return bundles.select("bundle", F.explode("places").alias("p")).select("p.page_id", "bundle", "p.frame", "p.start", "p.length")


def fetch(data: bytes, frame: int, start: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle by its place in the index."""
    at, size, _ = seek_table(data)[frame]
    return parse(zstandard.ZstdDecompressor().decompress(data[at : at + size])[start : start + length])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the index; a response's digest and size are those of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i in range(b.num_rows):
                data, rows, now, plain = b.column(0)[i].as_py(), [], None, b""
                table = seek_table(data)
                for place in sorted(b.column(1)[i].as_py(), key=lambda x: (x["frame"], x["start"])):
                    if place["frame"] != now:
                        now = place["frame"]
                        at, size, length = table[now]
                        plain = expand(data[at : at + size])
                        if len(plain) != length:
                            raise ValueError("frame and seek table differ")
                    head, payload = parse(plain[place["start"] : place["start"] + place["length"]])
                    n, digest, refers_to = int(head["X-Payload-Bytes"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if _page(head["WARC-Record-ID"]) != place["page_id"]:
                        raise ValueError("record and index differ")
                    if head["WARC-Type"] == "response":
                        if len(payload) != n or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError("payload and digest differ")
                    else:
                        refers_to = _page(head["WARC-Refers-To"])
                    rows.append((place["page_id"], n, digest, head["WARC-Type"], refers_to))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.select("data", "places").mapInArrow(K.lean(run), RECORDS)
