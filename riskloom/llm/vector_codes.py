"""Vector code compression: product codebooks learned by filtering Lloyd over kd-trees.

Vectors become integers (floor(``SCALE`` * x)) and are cut into ``PARTS`` equal parts; each part position has a codebook of at most ``ENTRIES``
entries, which starts as that part of the smallest vec_ids.

* **Trees.**  Every partition gathers its vectors in chunks of bounded size and builds a kd-tree over each part of a chunk, once:
  halves by the widest side of a node's box, down to ``LEAF`` points.  A node keeps its box, the sum of its points and their number.
  The chunks are written to the shared folder and read again in every round, so a lost executor costs one task.
* **Filtering.**  In a round each tree is walked from its root, level by level, with the entries that may still be nearest.  At a node
  the entry nearest to the middle of the box is held against the others: one that is nowhere in the box nearer goes.  Where a single
  entry is left, the whole subtree is its own, by the cached sum and number; at a leaf the points are compared with what is left.
* **Means.**  A task returns a sum and a number for each entry that it used; Spark adds them up, and the driver sees the codebooks only,
  whose size is a parameter.

All of it is exact: integers throughout, or doubles where every term stays below 2**53.  Ties go to the lower entry.

Edge cases: rows whose vector is null or holds a null, a NaN or an infinity are dropped.  Vectors of another length than the smallest
vec_id's, and all vectors if that length is no positive multiple of ``parts``, have no code: code and error are null and count for
nothing else.  Fewer vectors than ``entries`` give a smaller codebook.  A null vec_id comes after all others; rows that share one start
in the order of their vectors, and each gets its code; equal vectors may be several entries, of which the first is used.  Components are
held to what a sum of squares can carry (2**27 for parts of 16 numbers, that is |x| up to 131,072).  Null labels count as
one label.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import cut, join_groups, tune

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Points of a leaf at most; numbers of a chunk at most (and its vectors).
LEAF, CHUNK_NUMBERS, CHUNK_VECTORS = 32, 1 << 20, 8192


def largest(width: int) -> int:
    """The largest component for which ten squared distances of that many numbers fit 63 bits."""
    return 1 << ((58 - max(1, width - 1).bit_length()) // 2)


def edges(n: int, depth: int) -> np.ndarray:
    """Borders of the nodes of one level, n points halved so many times."""
    e = np.array([0, n])
    for _ in range(depth):
        out = np.empty(2 * len(e) - 1, dtype=np.int64)
        out[::2], out[1::2] = e, (e[:-1] + e[1:]) // 2
        e = out
    return e


class Tree:
    """A kd-tree over the rows of points: they stand in tree order, ``order`` says where each came from; nodes level by level."""

    def __init__(self, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray, order: np.ndarray | None = None):
        self.points, self.lo, self.hi, self.sums, self.order = points, lo, hi, sums, order
        self.depth = (len(lo) + 1).bit_length() - 2

    @classmethod
    def grow(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        n = len(points)
        depth = max(0, (-(-n // leaf) - 1).bit_length())
        order = np.arange(n)
        for level in range(depth):
            e = edges(n, level)
            for a, b in zip(e[:-1], e[1:], strict=True):
                own = points[order[a:b]]
                side = own[:, np.argmax(own.max(0) - own.min(0))]
                order[a:b] = order[a:b][np.argpartition(side, (a + b) // 2 - a)]
        points = points[order]
        e = edges(n, depth)[:-1]
        levels = [tuple(f.reduceat(points, e) for f in (np.minimum, np.maximum, np.add))]
        for _ in range(depth):
            lo, hi, sums = levels[0]
            levels.insert(0, (np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), sums[::2] + sums[1::2]))
        return cls(points, *(np.concatenate(x) for x in zip(*levels, strict=True)), order)

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """For each point, in tree order, its nearest entry; sums and numbers for each entry; how many points came with whole subtrees."""
        n, w = self.points.shape
        top = int(max(np.abs(self.lo[0]).max(), np.abs(self.hi[0]).max(), np.abs(book).max()))
        kind = np.float64 if 10 * w * top * top < 1 << 53 else np.int64
        b = book.astype(kind)
        norm, index = (b * b).sum(1), np.arange(len(b))
        found, whole = np.empty(n, dtype=np.int64), np.zeros(n, dtype=bool)
        sums, counts = np.zeros((len(b), w), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        nodes, open_ = np.zeros(1, dtype=np.int64), np.ones((1, len(b)), dtype=bool)
        for level in range(self.depth + 1):
            e, at = edges(n, level), (1 << level) - 1 + nodes
            twice, width = (self.lo[at] + self.hi[at]).astype(kind), (self.hi[at] - self.lo[at]).astype(kind)
            near = norm - twice @ b.T  # distance from the middle, but for what all entries share
            near[~open_] = np.inf if kind is np.float64 else np.iinfo(np.int64).max
            best = near.argmin(1)
            for z in np.unique(best):
                rows, off = np.flatnonzero(best == z), b - b[z]
                # how much nearer than z an entry can be within the box
                gain = norm[z] - norm + twice[rows] @ off.T + width[rows] @ np.abs(off).T
                open_[rows] &= (gain > 0) | ((gain == 0) & (index <= z))
            one = open_.sum(1) == 1
            for node, z in zip(nodes[one], best[one], strict=True):
                found[e[node] : e[node + 1]], whole[e[node] : e[node + 1]] = z, True
            np.add.at(sums, best[one], self.sums[at[one]])
            np.add.at(counts, best[one], e[nodes[one] + 1] - e[nodes[one]])
            nodes, open_ = nodes[~one], open_[~one]
            if level < self.depth:
                nodes, open_ = (np.repeat(2 * nodes, 2).reshape(-1, 2) + [0, 1]).ravel(), np.repeat(open_, 2, axis=0)
        for node, left in zip(nodes, open_, strict=True):
            some, own = np.flatnonzero(left), self.points[e[node] : e[node + 1]].astype(kind)
            found[e[node] : e[node + 1]] = some[(norm[some] - 2 * (own @ b[some].T)).argmin(1)]
        rest = np.flatnonzero(~whole)
        if len(rest):
            rest = rest[np.argsort(found[rest], kind="stable")]
            entry, first, number = np.unique(found[rest], return_index=True, return_counts=True)
            sums[entry] += np.add.reduceat(self.points[rest], first)
            counts[entry] += number
        return found, sums, counts, int(whole.sum())


# --- chunks of trees as rows ------------------------------------------------------------------------------------

_BLOBS = ("points", "lo", "hi", "sums")
_TREE = pa.struct([(k, pa.binary()) for k in (*_BLOBS, "places")])


def _pack(a: np.ndarray) -> bytes:
    """Integers in the least of four widths, which the first byte names."""
    kind = next(k for k in "bhiq" if np.iinfo(k).min <= a.min() and a.max() <= np.iinfo(k).max)
    return kind.encode() + a.astype(np.dtype(kind).newbyteorder("<")).tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.dtype(chr(raw[0])).newbyteorder("<"), offset=1).astype(np.int64).reshape(-1, width)


def _trees(row: dict, width: int) -> list[Tree]:
    return [Tree(*(_unpack(t[k], width) for k in _BLOBS), _unpack(t["places"], 1)[:, 0] if "places" in t else None) for t in row["trees"]]


def _grown(vectors: DataFrame, length: int, parts: int) -> DataFrame:
    """Chunks of (vec_id, label, _v), vectors of that length: keys in order and a tree for each part."""
    width, room = length // parts, max(1, min(CHUNK_VECTORS, CHUNK_NUMBERS // length))
    tree = T.StructType([T.StructField(k, T.BinaryType()) for k in (*_BLOBS, "places")])
    keys = T.StructType([f for f in vectors.schema.fields if f.name != "_v"])
    out = T.StructType([T.StructField("keys", T.ArrayType(keys)), T.StructField("trees", T.ArrayType(tree))])

    def chunk(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        flat = rows.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(flat * SCALE), -largest(width), largest(width)).astype(np.int64).reshape(-1, length)
        trees = []
        for p in range(parts):
            t = Tree.grow(whole[:, p * width : (p + 1) * width])
            trees.append({k: _pack(getattr(t, k)) for k in _BLOBS} | {"places": _pack(t.order)})
        own = rows.select(["vec_id", "label"]).to_struct_array()
        own = pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([trees], pa.list_(_TREE))], ["keys", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                take = min(room - n, b.num_rows - at)
                held.append(b.slice(at, take))
                n, at = n + take, at + take
                if n == room:
                    yield chunk(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield chunk(pa.Table.from_batches(held))

    return cut(vectors.mapInArrow(K.lean(run), out), "trees")


def _round(grown: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: (parts, entries, width)."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for b in batches:
            for i in range(b.num_rows):
                for p, t in enumerate(_trees(b.slice(i, 1).to_pylist()[0], width)):
                    _, s, c, _ = t.assign(books[p])
                    sums[p] += s
                    counts[p] += c
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    read = grown.select(F.transform("trees", lambda t: F.struct(*[t[k].alias(k) for k in _BLOBS])).alias("trees"))
    told = read.mapInArrow(K.lean(run), "part long, entry long, n long, sums array<long>")
    total = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    new = books.copy()
    for r in total.collect():  # the codebook: parts * entries rows at most
        new[r.part, r.entry] = np.array(r.sums) // r.n
    return new


def _coded(grown: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error for every vector of the chunks."""
    parts, _, width = books.shape
    keys = grown.schema["keys"].dataType.elementType
    hex_ = np.array([f"{i:02x}" for i in range(256)], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = b.column("keys").slice(i, 1).flatten()
                code, error = np.full(len(own), "", dtype=object), np.zeros(len(own), dtype=np.int64)
                for p, t in enumerate(_trees(b.select(["trees"]).slice(i, 1).to_pylist()[0], width)):
                    found = t.assign(books[p])[0]
                    code[t.order] += hex_[found]
                    error[t.order] += ((t.points - books[p][found]) ** 2).sum(1)
                for at in range(0, len(own), 2048):
                    to = min(at + 2048, len(own))
                    yield pa.RecordBatch.from_arrays([*own.slice(at, to - at).flatten(), pa.array(code[at:to], pa.string()), pa.array(error[at:to])], ["vec_id", "label", "code", "error"])

    return grown.mapInArrow(K.lean(run), T.StructType([*keys.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def usable(vector: Column) -> Column:
    """True for a vector of finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with the sum of error over its label; a label of any number of rows is no hot key."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = coded.withColumn("_key", key)
    sums = rows.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return join_groups(rows, sums, "_key").drop("_key")


def vector_codes(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) for each usable row of table (vec_id, embedding, label), and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hexadecimal digits")
    spark = table.sparkSession
    tune(spark)
    rows = table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("_v")).where(usable(F.col("_v")))
    first = F.col("vec_id").asc_nulls_last(), F.col("_v")
    starts = [r["_v"] for r in rows.orderBy(*first).limit(entries).collect()]
    length = len(starts[0]) if starts else 0
    if not length or length % parts:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error")), np.zeros((parts, 0, 0), dtype=np.int64)
    fits = rows.where(F.size("_v") == length)
    if any(len(v) != length for v in starts):
        starts = [r["_v"] for r in fits.orderBy(*first).limit(entries).collect()]
    width = length // parts
    whole = np.clip(np.floor(np.array(starts) * SCALE), -largest(width), largest(width)).astype(np.int64)
    books = np.ascontiguousarray(whole.reshape(-1, parts, width).swapaxes(0, 1))
    grown = _grown(fits, length, parts)
    for _ in range(rounds):
        books = _round(grown, books)
    odd = rows.where(F.size("_v") != length).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return with_label_error(cut(_coded(grown, books).unionAll(odd), "codes")), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
