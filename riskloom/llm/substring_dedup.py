"""Substring dedup with difference-cover anchors.

A window is ``WIDTH`` (20) consecutive words of one document.  Every word that stands in a
window whose word sequence also starts earlier - in a document with a smaller ``doc_id``, or
earlier in the same document - is removed.  Windows are judged on the input, not on what is left.

1. **Anchors.**  ``COVER`` = {0, 1, 3, 9} is a difference cover modulo 13: for any two places i, j
   some offset d < 13 puts both i + d and j + d on the cover.  Hashing the ``ANCHOR`` = 20 - 12 = 8
   words at cover places only (31 % of all places), two equal windows always share an aligned anchor.
   Anchor hashes meet in a packed exchange; those that occur once are gone after it.
2. **Extension.**  Only windows around repeated anchors are hashed whole: 64 bits, and the bucket by an
   independent hash, so that the bits compared grow with the number of buckets.  A second exchange
   marks every occurrence but the first.
3. Marks (place and window hash) return to their document, where each is held against the window that stands there;
   the words of those confirmed go.

Mappers send one entry a hash and flush, so a passage in a third of all documents adds as many
entries to a bucket as there are flushes, not as there are documents.

Edge cases: null or blank text has no words (``n_words`` 0, empty kept text).  A null ``doc_id`` has
no place in the order: the row is returned whole and takes no part in matching, nor in a join.  Rows of one ``doc_id``
are versions of one document: a window starts earlier if it does so in a smaller id, or at a smaller place of any version;
at the same place neither removes it from the other (so identical rows get identical results), and what only one version
holds is never removed from it for the other's sake.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as P
from . import textkernel as K
from .common import partitions, tune

WIDTH = 20
PERIOD = 13
COVER = (0, 1, 3, 9)


def _layout(width: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor words) for a window width: the largest perfect cover that leaves an anchor of 8 words or, for narrow windows, of one or more."""
    for period, cover in ((13, COVER), (7, (0, 1, 3)), (3, (0, 1)), (1, (0,))):
        if width - period + 1 >= (8 if period == 13 else 1):
            return period, cover, width - period + 1
    raise ValueError("width must be positive")


def _per_word(words: K.Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its document's id, its place there, and how many words follow it there (itself included)."""
    counts = np.diff(words.offsets)
    start = np.repeat(words.offsets[:-1], counts)
    place = np.arange(len(words.h)) - start
    return np.repeat(ids, counts), place, np.repeat(counts, counts) - place


def _ids(chunk: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows with an id, and the ids."""
    known = chunk.filter(chunk.column(0).is_valid())
    return known, known.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def anchors(width: int, buckets: int):
    period, cover, length = _layout(width)
    on = np.zeros(period, dtype=bool)
    on[list(cover)] = True

    def flush(h, doc, pos) -> Iterator[pa.RecordBatch]:
        order, first, size = P.first_of_groups(h, doc, pos)
        h, doc, pos = h[order], doc[order], pos[order]
        yield from P.rows_of(P.bucket_of(h[first], buckets), 0, h[first], doc[first], pos[first], False)
        again = size > 1  # repeated within this flush: known already, no need to meet the others
        yield from P.rows_of(P.bucket_of(K.mix(doc[again].astype(np.uint64)), buckets), 1, h[again], doc[again], pos[again], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = P.Collector(flush)
        for b in batches:
            for chunk in K.chunks(b):
                chunk, ids = _ids(chunk)
                words = K.words_of(chunk.column(1))
                h = K.windows(words.h, length, 1)
                doc, place, left = (x[: len(h)] for x in _per_word(words, ids))
                n = place + left
                keep = on[place % period] & (left >= length) & (n >= width)
                yield from held.add(h[keep], doc[keep], place[keep])
        yield from held.end()

    return run


def repeated(buckets: int):
    """Anchors that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = P.Collector(lambda _, doc, pos: P.flags(doc, pos, buckets))
        for kinds in P.buckets(batches, False):
            if 1 in kinds:
                yield from held.add(*kinds[1])
            if 0 in kinds:
                h, doc, pos = kinds[0]
                order, _, size = P.first_of_groups(h, doc, pos)
                again = order[size > 1]
                yield from held.add(h[again], doc[again], pos[again])
        yield from held.end()

    return run


def candidates(width: int, buckets: int):
    period, _, length = _layout(width)

    def flush(h, doc, pos, other) -> Iterator[pa.RecordBatch]:
        order, first, _ = P.first_of_groups(h, doc, pos)
        h, doc, pos, other = h[order], doc[order], pos[order], other[order]
        yield from P.rows_of(P.bucket_of(other[first], buckets), 0, h[first], doc[first], pos[first], True)
        later = ~first & ~_same(h, doc, pos)
        yield from P.rows_of(P.bucket_of(K.mix(doc[later].astype(np.uint64)), buckets), 1, h[later], doc[later], pos[later], True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = P.Collector(flush)
        for b in batches:
            for chunk in K.chunks(b.filter(b.column(2).is_valid())):
                chunk, ids = _ids(chunk)
                words = K.words_of(chunk.column(1))
                near = np.zeros(len(words.h) + 1, dtype=np.int64)
                for k, cell in enumerate(chunk.column(2).to_pylist()):
                    at = P.places(cell) + words.offsets[k]
                    at = at[at < words.offsets[k + 1]]
                    np.add.at(near, np.maximum(at - (period - 1), words.offsets[k]), 1)
                    np.add.at(near, at + 1, -1)
                h = K.windows(words.h, width, 2)
                doc, place, left = (x[: len(h)] for x in _per_word(words, ids))
                keep = (np.cumsum(near)[: len(h)] > 0) & (left >= width)
                yield from held.add(h[keep], doc[keep], place[keep], K.windows(words.h, width, 3)[keep])
        yield from held.end()

    return run


def _same(h, doc, pos) -> np.ndarray:
    """Sorted entries that equal the one before them in all three: one row of the input given twice."""
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])
    return same


def later(buckets: int):
    """Windows that are not the first of their sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = P.Collector(lambda h, doc, pos: P.flags(doc, pos, buckets, h))
        for kinds in P.buckets(batches, True):
            if 1 in kinds:
                yield from held.add(*kinds[1])
            if 0 in kinds:
                h, doc, pos = kinds[0]
                order, first, _ = P.first_of_groups(h, doc, pos)
                h, doc, pos = h[order], doc[order], pos[order]
                # a repeated row repeats its own first occurrence; that is no earlier place
                head = np.flatnonzero(first)
                size = np.diff(np.r_[head, len(h)])
                other = (doc != np.repeat(doc[head], size)) | (pos != np.repeat(pos[head], size))
                yield from held.add(h[other], doc[other], pos[other])
        yield from held.end()

    return run


def removal(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for i, (cell, hashes) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                text = b.column(1)[i].as_py()
                words = text.encode().split() if text else []
                total, gone = len(words), 0
                if cell and total >= width:
                    h = K.windows(K.words_of(b.column(1).slice(i, 1)).h, width, 2)
                    at, found = P.places(cell), K.unplanes(hashes, np.uint32)
                    here = at < len(h)
                    at, found = at[here], found[here]
                    at = at[h[at].astype(np.uint32) == found]
                    edge = np.zeros(total + 1, dtype=np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    gone = total - int(stays.sum())
                    words = list(compress(words, stays.tolist())) if gone else words
                n_words.append(total)
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for each row of docs (columns doc_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = partitions(docs)
    n = parts * P.PER_PARTITION
    met = P.exchange(docs.mapInArrow(K.lean(anchors(width, n)), P.SCHEMA), parts)
    hits = P.by_document(met.mapInArrow(K.lean(repeated(parts)), P.SCHEMA), parts)
    near = docs.where(F.col("doc_id").isNotNull()).join(hits.hint("merge"), "doc_id", "left").select("doc_id", "text", "places")
    met = P.exchange(near.mapInArrow(K.lean(candidates(width, n)), P.SCHEMA), parts)
    marks = P.by_document(met.mapInArrow(K.lean(later(parts)), P.SCHEMA), parts)
    # both joins deal the texts alike, so that they travel once; rows without an id stay where they are
    known = docs.where(F.col("doc_id").isNotNull()).join(marks.hint("merge"), "doc_id", "left").select("doc_id", "text", "places", "hashes")
    rest = docs.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("hashes"))
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    return known.mapInArrow(K.lean(removal(width)), schema).unionAll(rest.mapInArrow(K.lean(removal(width)), schema))
