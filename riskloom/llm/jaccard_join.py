"""N-gram Jaccard join as a distributed T-occurrence search (DivideSkip).

A document's set holds its distinct shingles of ``k`` (4) words (A-Z lower-cased; with fewer words
the whole sequence; without words it is empty and linked with nothing).  Two documents link when
|x & y| >= threshold * |x | y|; a component is what links reach.

**Lists.**  Sets of one size band are dealt over K segments by shingle hash; a record holds one key
for each segment that is not empty (hash of its content), and the inverted list of a key is the
documents with it.  A linked pair of sizes n, m differs in at most D = (1-t)/(1+t) * (n + m)
shingles, and each spoils one segment, so it shares at least T = keys - D of about 2 D keys: a
T-occurrence search.  A set near its band's lower border is written in the scheme of the band below too,
and what it shares with a set there are keys of that scheme; so keys and lists are counted for each scheme (a key's
lowest bit tells a document's two schemes apart).  No link can be missed.

**Divide.**  Lists of up to ``SHORT`` documents are merged: their pairs are counted.  Longer lists
are never expanded: a pair is a candidate if its count reaches T - L, L the long lists of the record,
and is then probed (binary search of one sorted set in the other, the exact check).

**Records with L >= T in one of their schemes** - only members of dense clusters - have nothing to merge.  Each is first
probed against the smallest member of its long lists; what stays apart meets in blocks, each a local
DivideSkip over the full key lists (heap merge of the short ones, binary search in the long ones) that
probes its candidates at once and skips those in one component with the query.  The largest component of
a size band is searched, but never queries.

Exact copies are found by a digest of the set and stand for one record.  A list that grows long
within one mapper's flush is sent as a mark, so a list held by a third of all documents stays small
everywhere.  Nothing but counts reaches the driver.

Edge cases: null or blank text: empty set, component_id is its own doc_id.  A null doc_id gets its
set size and a null component_id, and links nothing.  Rows that share a doc_id with equal text give
equal rows; with different texts each row keeps its set size, and the id is linked with whatever one of its texts links
with (such texts are nodes of their own, tied to their id, whatever the order of rows).  Ids must leave room above the
largest for as many fresh ones, else a ValueError says so.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as P
from . import textkernel as K
from .common import cut, join_groups, left_join_known, partitions, tune
from .components import components

SHINGLE = 4
NUMERATOR, DENOMINATOR = 85, 100
BAND = 1.5
SHORT = 32
#: Shingles of a block in the local search of dense clusters.
BLOCK = 200_000
#: Entries of lists up to which the local search merges through a heap.
MERGE = 512

OUT = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("keys", pa.int64())])
OUT_SCHEMA = "kind string, a long, b long, n long, keys long"


class Rule:
    """Threshold num/den, shingle width k, and what follows from them."""

    def __init__(self, k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR):
        self.k, self.num, self.den = k, num, den

    def most(self, total):
        """Largest symmetric difference of a linked pair whose sizes add up to total."""
        return (self.den - self.num) * total // (self.den + self.num)

    def keys_needed(self, keys: int, n: int) -> int:
        """T for a set of size n with so many keys, whatever the other's size."""
        return keys - self.most(n + n * self.den // self.num)

    def linked(self, both, n, m):
        return self.den * both >= self.num * (n + m - both)

    def band(self, n: int) -> int:
        b = max(0, int(math.log(n, BAND)) - 1)
        while n >= self.low(b + 1):
            b += 1
        return b

    def low(self, b: int) -> int:
        """Smallest size of band b."""
        return math.ceil(BAND**b)

    def segments(self, b: int) -> int:
        top = self.low(b + 1) - 1
        return 2 * self.most(top + top * self.den // self.num) + 6

    def schemes(self, n: int) -> list[int]:
        """Bands whose segmentation a set of size n is written in: its own, and the one below if a linked set may be there."""
        b = self.band(n)
        return [b] + ([b - 1] if b and -(-self.num * n // self.den) < self.low(b) else [])

    def keys(self, s: np.ndarray, b: int) -> tuple[np.ndarray, int]:
        """64-bit keys of the non-empty segments of a set in scheme b, and their number; where that is so
        small that T may be 0, one more key that all such sets of the scheme have.  The lowest bit is the scheme's."""
        k = self.segments(b)
        with np.errstate(over="ignore"):
            m = K.mix(s ^ np.uint64(0xA5A5A5A5A5A5))
            at = (m % np.uint64(k)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            at, m = at[order], K.mix(m[order] + np.uint64(b))
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            keys = K.mix(np.add.reduceat(m, first) + at[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b))
        keys = (keys & ~np.uint64(1)) | np.uint64(b & 1)
        top, own = self.low(b + 1) - 1, len(keys)
        if own <= self.most(top + top * self.den // self.num):
            keys = np.r_[keys, np.uint64((1 << 63) + b)]
        return keys, own


def sets_of(chunk: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of the chunk's second column."""
    words = K.words_of(chunk.column(1), lower=True)
    win = K.windows(words.h, k, 7)
    out = []
    for a, e in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if e - a >= k:
            out.append(np.unique(win[a : e - k + 1]))
        elif e > a:
            out.append(np.frombuffer(hashlib.blake2b(words.h[a:e].tobytes(), digest_size=8).digest(), dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _known(b: pa.RecordBatch) -> pa.RecordBatch:
    return b.filter(b.column(0).is_valid())


STAT, EXACT, KEY, BELOW = 0, 1, 2, 3


def emit(rule: Rule, buckets: int):
    """Entries for the exchange: sizes (pos: size, h: twice the keys and the scheme's lowest bit; STAT of the own
    scheme, BELOW of the one below), digests, keys, and marks of keys that are long already here."""

    def flush(h, doc, kind, by) -> Iterator[pa.RecordBatch]:
        for what in (EXACT, KEY):
            is_ = kind == what
            hh, dd, bb = h[is_], doc[is_], by[is_]
            order, first, size = P.first_of_groups(hh, dd, np.zeros(len(hh), dtype=np.int64))
            hh, dd, bb = hh[order], dd[order], bb[order]
            head = np.flatnonzero(first)
            hub = np.repeat(dd[head], np.diff(np.r_[head, len(hh)]))
            long = size > (1 if what == EXACT else SHORT)
            out = first | ~long
            yield from P.rows_of(P.bucket_of(bb[out & ~long], buckets), what, hh[out & ~long], dd[out & ~long], np.zeros(int((out & ~long).sum()), dtype=np.int64), True)
            yield from P.rows_of(P.bucket_of(bb[first & long], buckets), 10 + what, hh[first & long], dd[first & long], np.zeros(int((first & long).sum()), dtype=np.int64), True)
            # members of a long list: an edge to its smallest member here (h: that member), one list more (pos: of which scheme)
            x, y = dd[long], hub[long]
            yield from P.rows_of(P.bucket_of(K.mix(x.astype(np.uint64)), buckets), 20 + what, y.astype(np.uint64), x, (hh[long] & np.uint64(1)).astype(np.int64), True)
        for what in (STAT, BELOW):
            is_ = (kind < 0) & (by == what)
            yield from P.rows_of(P.bucket_of(K.mix(doc[is_].astype(np.uint64)), buckets), what, h[is_], doc[is_], -kind[is_] - 1, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = P.Collector(flush)
        for b in batches:
            for chunk in K.chunks(_known(b)):
                ids = chunk.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                hs, ds, ks, bs = [], [], [], []  # hash, document, kind, and what the bucket goes by
                for doc, s in zip(ids.tolist(), sets_of(chunk, rule.k), strict=True):
                    n = len(s)
                    if not n:
                        continue
                    for what, b_ in zip((STAT, BELOW), rule.schemes(n), strict=False):
                        keys, count = rule.keys(s, b_)
                        hs += [keys, np.array([2 * count + (b_ & 1)], dtype=np.uint64)]
                        bs += [keys, np.array([what], dtype=np.uint64)]
                        ks += [np.full(len(keys), KEY, dtype=np.int64), np.array([-n - 1])]
                        ds.append(np.full(len(keys) + 1, doc, dtype=np.int64))
                    # half of a 128-bit digest is compared, the other half chooses the bucket
                    digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.uint64)
                    hs.append(digest[:1])
                    bs.append(digest[1:])
                    ks.append(np.array([EXACT]))
                    ds.append(np.array([doc], dtype=np.int64))
                if hs:
                    yield from held.add(np.concatenate(hs), np.concatenate(ds), np.concatenate(ks), np.concatenate(bs))
        yield from held.end()

    return run


def _rows(kind: str, a, b=None, n=None, keys=None) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(a), 50_000):
        cut_ = slice(lo, lo + 50_000)
        size = len(a[cut_])
        cols = [pa.array([kind] * size, pa.string())] + [pa.nulls(size, pa.int64()) if x is None else pa.array(x[cut_].astype(np.int64)) for x in (a, b, n, keys)]
        if size:
            yield pa.RecordBatch.from_arrays(cols, schema=OUT)


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket: sizes, exact edges, counted pairs of short lists, edges and list counts of long ones; b of
    sizes and list counts is the lowest bit of the scheme."""

    def listed(doc: np.ndarray, bit: np.ndarray) -> Iterator[pa.RecordBatch]:
        for x in (0, 1):
            ids, n = np.unique(doc[bit == x], return_counts=True)
            yield from _rows("long", ids, np.full(len(ids), x), n)

    none = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32))
    for kinds in P.buckets(batches, True):
        for what, kind in ((STAT, "stat"), (BELOW, "below")):
            h, doc, pos = kinds.get(what, none)
            yield from _rows(kind, doc, h & np.uint64(1), pos, h >> np.uint64(1))
        for what in (EXACT, KEY):
            h, doc, bit = kinds.get(20 + what, none)
            hub = h.astype(np.int64)
            yield from _rows("exact" if what == EXACT else "star", doc[doc != hub], hub[doc != hub])
            if what == KEY:
                yield from listed(doc, bit)
            (h, doc, _), (mh, md, _) = kinds.get(what, none), kinds.get(10 + what, none)
            mark = np.r_[np.zeros(len(h), dtype=bool), np.ones(len(mh), dtype=bool)]
            h, doc = np.r_[h, mh], np.r_[doc, md]
            order, first, size = P.first_of_groups(h, doc, np.zeros(len(h), dtype=np.int64))
            h, doc, mark = h[order], doc[order], mark[order]
            head = np.flatnonzero(first)
            count = np.diff(np.r_[head, len(h)])
            if not len(head):
                continue
            hub = np.repeat(doc[head], count)
            long = (size > SHORT) | np.repeat(np.logical_or.reduceat(mark, head), count)
            if what == EXACT:
                yield from _rows("exact", doc[doc != hub], hub[doc != hub])
                continue
            x = long & (doc != hub)
            yield from _rows("star", doc[x], hub[x])
            yield from listed(doc[long & ~mark], h[long & ~mark] & np.uint64(1))
            # short lists: entry i with the 1st, 2nd, ... entry before it in its list; a pair as one number
            ids, to = np.unique(doc, return_inverse=True)
            at = np.arange(len(h)) - np.repeat(head, count)
            pairs = [np.zeros(0, dtype=np.int64)]
            for back in range(1, int(count[~long[head]].max(initial=1))):
                i = np.flatnonzero(~long & (at >= back))
                i = i[to[i - back] != to[i]]
                pairs.append(to[i - back] * len(ids) + to[i])
            pairs = np.concatenate(pairs)
            pairs.sort()
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])[: len(pairs)]
            n = np.diff(np.r_[first, len(pairs)])
            pairs = pairs[first]
            yield from _rows("pair", ids[pairs // len(ids)], ids[pairs % len(ids)], n)


def set_rows(rule: Rule):
    """Sets of rows sorted by doc_id; a row given again is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            ids = b.column(0).to_pylist()
            new = [x != y for x, y in zip(ids, [last, *ids[:-1]], strict=True)]
            last = ids[-1] if ids else last
            for chunk in K.chunks(b.filter(pa.array(new, pa.bool_()))):
                yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array([s.tobytes() for s in sets_of(chunk, rule.k)], pa.binary())], ["doc_id", "set"])

    return run


def probe(rule: Rule):
    """Pairs (a, b, set_a, set_b) that link: the shorter set is searched in the longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                s, t = (s, t) if len(s) <= len(t) else (t, s)
                if not len(s) or rule.den * len(s) < rule.num * len(t):
                    yes.append(False)
                    continue
                yes.append(bool(rule.linked(_overlap(s, t), len(s), len(t))))
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    return run


def divide_skip(query: list[int], index: dict[int, np.ndarray], t: int) -> np.ndarray:
    """Documents (ascending) on at least t of the query's lists (each ascending).

    The t - 1 longest lists are set aside: whatever is on t lists is on one of the others.  Those are
    merged - through a heap while they are few, by counting where they are many - and each document met
    is looked up in the long lists by binary search.
    """
    found = sorted((index[k] for k in query if k in index), key=len)
    if len(found) < t:
        return np.zeros(0, dtype=np.int64)
    short, long = found[: len(found) - t + 1], found[len(found) - t + 1 :]
    if sum(map(len, short)) <= MERGE:
        runs = [(doc, sum(1 for _ in run)) for doc, run in groupby(heapq.merge(*(x.tolist() for x in short)))]
        docs, n = np.array([x[0] for x in runs], dtype=np.int64), np.array([x[1] for x in runs], dtype=np.int64)
    else:
        docs, n = np.unique(np.concatenate(short), return_counts=True)
    for left, x in zip(range(len(long), 0, -1), reversed(long), strict=True):
        live = n + left >= t
        docs, n = docs[live], n[live]
        if not len(docs):
            break
        at = np.searchsorted(x, docs)
        n = n + (x[np.minimum(at, len(x) - 1)] == docs)
    return docs[n >= t]


def scheme_rows(rule: Rule):
    """A row for each scheme a dense record's set is written in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, cell, comp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rows += [(scheme, doc, comp, len(cell) // 8, cell) for scheme in (rule.schemes(len(cell) // 8) if cell else [])]
            yield P.batch(rows, pa.schema([("scheme", pa.int32()), ("doc_id", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("set", pa.binary())]))

    return run


def _overlap(s: np.ndarray, t: np.ndarray) -> int:
    at = np.searchsorted(t, s)
    return int((t[np.minimum(at, len(t) - 1)] == s).sum())


def block_search(rule: Rule):
    """Local DivideSkip of one pair of blocks, candidates probed on the spot: links that join two components."""
    import pandas as pd

    def run(key, pdf):
        scheme = int(key[0])
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        sets = [np.frombuffer(x, dtype=np.uint64) for x in right.set]
        lists: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            for k in rule.keys(s, scheme)[0].tolist():
                lists.setdefault(k, []).append(i)
        index = {k: np.array(v, dtype=np.int64) for k, v in lists.items()}
        ids, size, comp = right.doc_id.to_numpy(), right.n.to_numpy(), right.comp.to_numpy()
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        a, b = [], []
        for doc, c, cell in zip(left.doc_id, left.comp, left.set, strict=True):
            s = np.frombuffer(cell, dtype=np.uint64)
            n = len(s)
            query, own = rule.keys(s, scheme)
            at = divide_skip(query.tolist(), index, max(1, rule.keys_needed(own, n)))
            m = size[at]
            at = at[(comp[at] != c) & (rule.den * np.minimum(m, n) >= rule.num * np.maximum(m, n))]
            for i in at.tolist():
                x, y = root(int(c)), root(int(comp[i]))
                if x == y:  # joined already, by this block's links
                    continue
                if rule.linked(_overlap(s, sets[i]), n, len(sets[i])):
                    up[max(x, y)] = min(x, y)
                    a.append(doc)
                    b.append(ids[i])
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return run


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(K.lean(probe(rule)), "a long, b long")


def apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs with a column doc_id that tells texts apart beside own, the id they came with; and the fresh ids (doc_id, own) of
    texts whose id has others too, if there are any."""
    digest = F.xxhash64("text")
    seen = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    clash = cut(seen.where("low <> high").select(F.col("doc_id").alias("own")), "clash")
    if clash.isEmpty():
        return docs.withColumn("own", F.col("doc_id")), None
    top = docs.agg(F.max("doc_id")).collect()[0][0]
    texts = docs.select(F.col("doc_id").alias("own"), digest.alias("digest")).join(clash.hint("merge"), "own", "left_semi").distinct()
    fresh = cut(texts.withColumn("doc_id", F.monotonically_increasing_id() + F.lit(str(top + 1)).cast("decimal(20,0)")), "fresh")
    if not fresh.where(F.col("doc_id") >= F.lit(str(1 << 63)).cast("decimal(20,0)")).isEmpty():
        raise ValueError("no ids left above the largest doc_id for texts that share one")
    fresh = fresh.withColumn("doc_id", F.col("doc_id").cast("long"))
    named = docs.select(F.col("doc_id").alias("own"), "text", digest.alias("digest")).join(fresh.hint("merge"), ["own", "digest"], "left")
    return cut(named.select(F.coalesce("doc_id", "own").alias("doc_id"), "text", "own"), "named"), fresh.select("doc_id", "own")


def jaccard_join(docs: DataFrame, k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (columns doc_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    rule = Rule(k, num, den)
    docs, fresh = apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    texts = docs.select("doc_id", "text")
    parts = partitions(docs)
    met = P.exchange(texts.mapInArrow(K.lean(emit(rule, parts * P.PER_PARTITION)), P.SCHEMA), parts)
    found = cut(met.mapInArrow(K.lean(lists), OUT_SCHEMA), "lists")
    exact = cut(components(found.where("kind = 'exact'").select("a", "b")).where("node <> component"), "exact")
    copies = exact.select(F.col("node").alias("doc"), "component")

    def reps(pairs: DataFrame) -> DataFrame:
        """Pairs between records that stand for their exact copies; a copy shares all lists of its record, so only records' own pairs count."""
        gone = copies.select("doc")
        return pairs.join(gone.withColumnRenamed("doc", "a"), "a", "left_anti").join(gone.withColumnRenamed("doc", "b"), "b", "left_anti")

    most = lambda total: F.expr(f"({den - num}) * ({total}) div {den + num}")
    # a row for each document and scheme, then one for each document: long lists of both schemes, and whether those of one may be T
    each = found.where("kind IN ('stat', 'below', 'long')").groupBy(F.col("a").alias("doc"), "b").agg(
        F.max(F.when(F.col("kind") != "long", F.col("n"))).alias("n"),
        F.max(F.when(F.col("kind") == "stat", F.col("keys"))).alias("own"),
        F.max(F.when(F.col("kind") != "long", F.col("keys"))).alias("keys"),
        F.coalesce(F.sum(F.when(F.col("kind") == "long", F.col("n"))), F.lit(0)).alias("long"),
    )
    reached = F.col("long") >= F.col("keys") - most(f"n + n * {den} div {num}")
    stat = cut(each.groupBy("doc").agg(F.max("n").alias("n"), F.max("own").alias("keys"), F.sum("long").alias("long"), F.max(reached).alias("dense")), "stat")
    side = lambda c: stat.select(F.col("doc").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "keys", "long")])

    def plausible(pairs: DataFrame) -> DataFrame:
        return pairs.where((F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num))

    counted = reps(found.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("shared")))
    counted = plausible(counted.join(side("a"), "a").join(side("b"), "b"))
    own = F.when(F.col("n_a") <= F.col("n_b"), F.col("keys_a")).otherwise(F.col("keys_b"))
    counted = counted.where(F.col("shared") >= own - most("n_a + n_b") - F.least("long_a", "long_b")).select("a", "b")
    # records that may share T keys of a scheme on long lists alone
    dense = cut(stat.join(copies, "doc", "left_anti").where("dense").select("doc", "n"), "dense")
    star = cut(found.where("kind = 'star'").select("a", "b").distinct(), "star")
    record = lambda c: copies.select(F.col("doc").alias(c), F.col("component").alias("to"))
    # a mapper's smallest member may be a copy, and has a row for each member of its list
    hubs = star.groupBy("b").agg(F.count("*").alias("n")).join(record("b"), "b", "left").withColumn("y", F.coalesce("to", "b")).drop("to")
    hubs = hubs.join(dense.select(F.col("doc").alias("y"), F.col("n").alias("n_b")), "y")
    star = join_groups(star, hubs, "b").join(record("a"), "a", "left").select(F.coalesce("to", "a").alias("a"), F.col("y").alias("b"), "n_b").where("a <> b").distinct()
    star = plausible(star.join(dense.select(F.col("doc").alias("a"), F.col("n").alias("n_a")), "a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(counted.unionAll(star).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).unionAll(dense.select("doc")).distinct()
    # a sort-merge join at every size
    wanted = texts.where(F.col("doc_id").isNotNull()).join(ids.hint("merge"), "doc_id", "left_semi").sortWithinPartitions("doc_id")
    sets = cut(wanted.mapInArrow(K.lean(set_rows(rule)), "doc_id long, set binary"), "sets")
    links = cut(_verified(pairs, sets, rule), "links")
    edges = links.unionAll(exact.select(F.col("node").alias("a"), F.col("component").alias("b")))
    if fresh is not None:
        edges = edges.unionAll(fresh)
    comps = cut(components(edges), "comps")
    if not dense.isEmpty():
        more = _dense_links(dense.select("doc"), comps, sets, rule)
        if not more.isEmpty():
            comps = components(edges.unionAll(more))
    size = docs.select("doc_id", "text", "own").mapInArrow(K.lean(sizes(rule)), "doc_id long, n_shingles long, own long")
    known = left_join_known(cut(size, "sizes"), comps.withColumnRenamed("node", "doc_id"), "doc_id")
    return known.select(F.col("own").alias("doc_id"), "n_shingles", F.coalesce("component", "own").alias("component_id"))


def _dense_links(dense: DataFrame, comps: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between dense records of different components: blocks of keys, searched locally, then probed."""
    rows = sets.join(dense.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rows = rows.select("doc_id", "set", F.coalesce("component", "doc_id").alias("comp")).mapInArrow(K.lean(scheme_rows(rule)), "scheme int, doc_id long, comp long, n long, set binary")
    rows = cut(rows, "dense")
    # the largest component of a scheme needs no search within itself: its members are the index, never queries
    per = rows.groupBy("scheme", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    top = per.groupBy("scheme").agg(F.max_by("comp", F.struct("c", F.negate("comp"))).alias("top"), F.sum("n").alias("all"), F.count("*").alias("comps"))
    top = top.where("comps > 1").withColumn("blocks", F.ceil(F.col("all") / BLOCK).cast("int")).select("scheme", "top", "blocks")
    rows = rows.join(F.broadcast(top), "scheme")  # a row for each size band: tens
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    index = rows.withColumn("j", block).withColumn("i", each).withColumn("side", F.lit(1))
    query = rows.where("comp <> top").withColumn("i", block).withColumn("j", each).withColumn("side", F.lit(0))
    cols = ["scheme", "i", "j", "side", "doc_id", "comp", "n", "set"]
    return cut(index.select(cols).unionAll(query.select(cols)).groupBy("scheme", "i", "j").applyInPandas(block_search(rule), "a long, b long"), "denselinks")


def sizes(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in K.chunks(b):
                yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array([len(s) for s in sets_of(chunk, rule.k)], pa.int64()), chunk.column(2)], ["doc_id", "n_shingles", "own"])

    return run
