"""Vectorised word kernels over Arrow string columns (numpy only, no row loops).

Everything that hashes words, shingles or windows goes through this module, so that two
operators always see the same words.  Memory is bounded: a batch is cut into chunks of
about ``CHUNK_BYTES`` of text (one longer text is a chunk of its own).
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * _C2
    h = h ^ (h >> np.uint64(29))
    h = h * _C1
    return h ^ (h >> np.uint64(32))


def multipliers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers, one per offset in a window."""
    with np.errstate(over="ignore"):
        base = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1000)) * _C1
        return mix(base) | np.uint64(1)


def _trim() -> None:
    """Hand freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(run: Callable) -> Callable:
    """run for mapInArrow, in a worker that keeps no memory between tasks: Python workers are reused, and several stand
    idle beside the executor's heap."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            _trim()

    return inner


class Words:
    """Words of a run of texts: ``h`` hash of each word, ``starts``/``ends`` byte offsets in ``buf``,
    ``offsets`` (texts + 1) index of each text's first word."""

    __slots__ = ("buf", "ends", "h", "offsets", "starts")

    def __init__(self, buf, starts, ends, h, offsets):
        self.buf, self.starts, self.ends, self.h, self.offsets = buf, starts, ends, h, offsets


def _hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    with np.errstate(over="ignore"):
        h = lengths.astype(np.uint64) * _C1 + np.uint64(0x1234567)
        if not len(starts):
            return h
        padded = np.concatenate([buf, np.zeros(16, dtype=np.uint8)])
        view = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(padded) - 8,), strides=(1,))
        live, at, left = None, starts, lengths
        while True:
            part = view[at] & _MASKS[np.minimum(left, 8)]
            if live is None:
                h = mix(h ^ part)
            else:
                h[live] = mix(h[live] ^ part)
            more = left > 8
            if not more.any():
                return h
            live = np.flatnonzero(more) if live is None else live[more]
            at, left = at[more] + 8, left[more] - 8


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; null has none.  lower: A-Z are lower-cased first."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = texts.buffers()[2] if n else None
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, dtype=np.uint8)
    off = off - off[0]
    if lower:
        buf = _LOWER[buf]
    sep = _SEP[buf]
    first = np.empty(len(buf) + 1, dtype=bool)
    first[:] = True
    first[1:-1] = sep[:-1]
    first[off] = True  # a text begins: what stands before is no part of its words
    word = ~sep
    starts = np.flatnonzero(word & first[:-1])
    last = np.empty(len(buf) + 1, dtype=bool)
    last[:] = True
    last[:-1] = sep
    last[off] = True
    ends = np.flatnonzero(word & last[1:]) + 1
    h = _hash_words(buf, starts, ends)
    return Words(buf, starts, ends, h, np.searchsorted(starts, off))


def windows(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of each run of ``width`` words (len(h) - width + 1 of them; runs over text borders are the caller's to drop)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    m = multipliers(width, seed)
    with np.errstate(over="ignore"):
        out = h[:n] * m[0]
        for k in range(1, width):
            out += h[k : k + n] * m[k]
        return mix(out)


def chunks(batch: pa.RecordBatch, column: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK_BYTES of text each; column: the text's place, by default that named text."""
    n = batch.num_rows
    if not n:
        return
    texts = batch.column(batch.schema.get_field_index("text") if column is None else column).cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + CHUNK_BYTES, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


# --- packed entries: (hash, document, place) columns as byte planes, many entries a row ---------------------------


def planes(a: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane: equal high bytes stand together and compress well."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def pack_ids(ids: np.ndarray) -> bytes:
    """int64 ids as planes of differences."""
    with np.errstate(over="ignore"):
        return planes(np.diff(ids.astype(np.int64), prepend=np.int64(0)))


def unpack_ids(b: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unplanes(b, np.int64), dtype=np.int64)
