"""Packed hash exchange: (hash, document, place) entries travel many to a row.

A Spark row for each of 10**10 entries would cost more in row headers than in data.  Mappers
therefore sort a flush of entries by hash bucket and emit one row a bucket, its columns laid
out as byte planes; ``exchange`` brings a bucket's rows together, and reducers see one bucket
at a time as numpy arrays.  A bucket's size follows input / (partitions * PER_PARTITION), and
mappers send at most a few entries of any one hash per flush, so no hot hash fills a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as K

PER_PARTITION = 2
FLAG = 9
FLUSH = 600_000
SCHEMA = "bucket int, kind int, h binary, doc binary, pos binary"
ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("h", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary())])
FLAG_SCHEMA = "doc_id long, places binary, hashes binary"
FLAG_ARROW = pa.schema([("doc_id", pa.int64()), ("places", pa.binary()), ("hashes", pa.binary())])


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def rows_of(bucket: np.ndarray, kind: int, h: np.ndarray, doc: np.ndarray, pos: np.ndarray, wide: bool) -> Iterator[pa.RecordBatch]:
    """One row a bucket; within it entries stand by document and place.  wide: all 64 bits of h, else 32."""
    order = np.lexsort((pos, doc, bucket))
    bucket, h, doc, pos = bucket[order], h[order], doc[order], pos[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, dtype=np.int64)
    h = h if wide else h.astype(np.uint32)
    rows = []
    for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rows.append((int(bucket[a]), kind, K.planes(h[a:e]), K.pack_ids(doc[a:e]), K.planes(pos[a:e].astype(np.uint32))))
        if len(rows) >= 256:
            yield batch(rows, ARROW)
            rows = []
    if rows:
        yield batch(rows, ARROW)


def exchange(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "bucket").sortWithinPartitions("bucket")


def buckets(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each bucket of a partition sorted by bucket: {kind: (h, doc, pos)}."""
    now, held = None, {}

    def made():
        return {k: tuple(None if x[0] is None else np.concatenate(x) for x in zip(*v, strict=True)) for k, v in held.items()}

    for b in batches:
        cols = [b.column(i) for i in range(5)]
        for i in range(b.num_rows):
            at = cols[0][i].as_py()
            if at != now:
                if held:
                    yield made()
                now, held = at, {}
            kind, h, doc, pos = (c[i].as_py() for c in cols[1:])
            h = None if h is None else K.unplanes(h, np.uint64 if wide else np.uint32)
            held.setdefault(kind, []).append((h, K.unpack_ids(doc), K.unpack_ids(pos) if kind == FLAG else K.unplanes(pos, np.uint32)))
    if held:
        yield made()


def flags(doc: np.ndarray, pos: np.ndarray, n: int, h: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Marked places on their way to their documents: packed rows by document bucket, places as differences.  h: with 32
    bits of a hash of what was found there, so that texts which share an id can tell whose mark it is."""
    bucket = bucket_of(K.mix(doc.astype(np.uint64)), n)
    order = np.lexsort((pos, doc, bucket))
    bucket, doc, pos = bucket[order], doc[order], pos[order].astype(np.int64)
    h = None if h is None else h[order].astype(np.uint32)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, dtype=np.int64)
    rows = [(int(bucket[a]), FLAG, None if h is None else K.planes(h[a:e]), K.pack_ids(doc[a:e]), K.pack_ids(pos[a:e])) for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    for lo in range(0, len(rows), 256):
        yield batch(rows[lo : lo + 256], ARROW)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, places, hashes) of a partition of marks sorted by bucket: a row for each document; without hashes each place once."""
    for kinds in buckets(batches, False):
        h, doc, pos = kinds[FLAG]
        order = np.lexsort((pos, doc) if h is None else (h, pos, doc))
        doc, pos = doc[order], pos[order].astype(np.uint32)
        new = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]
        if h is not None:
            h = h[order]
            new[1:] |= h[1:] != h[:-1]
            h = h[new]
        doc, pos = doc[new], pos[new]
        edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
        for lo in range(0, len(edges) - 1, 512):
            some = edges[lo : lo + 513].tolist()
            spans = list(zip(some[:-1], some[1:], strict=True))
            hashes = pa.nulls(len(spans), pa.binary()) if h is None else pa.array([K.planes(h[a:e]) for a, e in spans], type=pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(doc[some[:-1]]), pa.array([K.pack_ids(pos[a:e]) for a, e in spans], type=pa.binary()), hashes], schema=FLAG_ARROW)


def by_document(df: DataFrame, parts: int) -> DataFrame:
    """All marked places of a document in one row: at most its own number of words."""
    return exchange(df, parts).mapInArrow(K.lean(gathered), FLAG_SCHEMA)


def places(cell: bytes | None) -> np.ndarray:
    return K.unpack_ids(cell) if cell else np.zeros(0, dtype=np.int64)


def first_of_groups(h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (h, doc, pos); mask of the first entry of each hash in that order; size of each entry's group."""
    order = np.lexsort((pos, doc, h))
    s = h[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(first)
    size = np.repeat(np.diff(np.r_[at, len(s)]), np.diff(np.r_[at, len(s)]))
    return order, first, size


Flush = Callable[..., Iterator[pa.RecordBatch]]


class Collector:
    """Holds entries (columns of equal length) until FLUSH of them, then hands them on."""

    def __init__(self, flush: Flush):
        self.flush, self.held, self.n = flush, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.held.append(columns)
            self.n += len(columns[0])
        if self.n >= FLUSH:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            columns = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            self.held, self.n = [], 0
            yield from self.flush(*columns)
