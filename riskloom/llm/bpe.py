"""Byte-level BPE encoding and decoding, long unsplit text by tree concatenation.

A text is cut at the added tokens; what stands between is split by the pre-tokenizer's pattern into pieces, and merges never
cross a piece.  Text that is still unsplit and long is handled as a tree on both levels: its halves are encoded on their own,
down to leaves, and joined bottom-up; at each join a window on both sides is encoded anew and grows until it agrees with both.

* **Splitting.**  A text of more than ``TEXT_LEAF`` characters.  The pattern looks at most ``REACH`` characters beyond a piece, so
  the left half's pieces stand, but for those that end nearer to the join than that; from there on the text is split again over
  a growing number of the right half's pieces, until a new border is one of the right half's: what follows a border depends
  on the text behind it alone, so both agree from there on.
* **Merging.**  A piece of more than ``LEAF`` bytes; leaves of one piece are merged in parallel threads.  A window of ``WINDOW``
  tokens on both sides is decoded and merged anew; when the new tokens begin with the left window's first token and end with
  the right window's last one, the join is exact: a token sequence is the encoding of its text if and only if each neighbouring
  pair is, every pair lies within one of the three encodings that agree, and merges are applied by rank alone.

Otherwise a window doubles, at the utmost to the whole.  Work is O(n log n) in the text's length.  Pieces of up to ``LEAF``
bytes are merged directly and kept in a bounded cache.

The vocabulary file's path is a parameter; the file is read once in each Python worker and never copied.

Edge cases: null is an empty text (no ids, decodes to ""); nothing else is special: repeated rows,
null ids and other columns pass through row by row, an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import tune

TEXT_LEAF = 2048
REACH = 4
LEAF = 512
WINDOW = 4
#: Distinct pieces a worker keeps.
CACHE = 400_000
#: The pre-tokenizer's pattern for byte-level vocabularies (a fixed, published value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def halves(n: int, leaf: int) -> list[tuple[int, int]]:
    """The leaves (from, to) of halving n places down to leaf at most, in order."""
    out, spans = [], [(0, n)]
    while spans:
        a, e = spans.pop()
        if e - a <= leaf:
            out.append((a, e))
        else:
            spans += [((a + e) // 2, e), (a, (a + e) // 2)]
    return out


def tree(parts: list, join: Callable) -> list:
    """Neighbours joined, level by level."""
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


class Codec:
    """Encoder and decoder of one vocabulary file (JSON with vocab, merges and added tokens)."""

    def __init__(self, path: str, leaf: int = LEAF, threads: int = 2, text_leaf: int = TEXT_LEAF):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("a byte-level BPE without prefix space or normalizer is asked for")
        chars = byte_chars()
        self.ids = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items()}
        ranks = {bytes([b]): b for b in range(256)}
        for i, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks[bytes(chars[c] for c in a + b)] = 256 + i
        self.core = tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.of_rank = {r: self.ids[t] for t, r in ranks.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        self.leaf, self.threads, self.text_leaf = leaf, threads, text_leaf
        codec = self

        class Cache(dict):
            def __missing__(self, piece: str) -> bytes:
                raw = piece.encode()
                out = np.array(codec.encode_piece(raw), dtype="<u4").tobytes()
                if len(raw) <= 64:
                    if len(self) >= CACHE:
                        self.clear()
                    self[piece] = out
                return out

        self.cache = Cache()

    def merge(self, raw: bytes) -> list[int]:
        """Plain merging by rank."""
        return [self.of_rank[r] for r in self.core._encode_single_piece(raw)]

    def split(self, text: str) -> list[str]:
        """The pieces of a text without added tokens."""
        if len(text) <= self.text_leaf:
            return self.pieces(text)
        return tree([self.pieces(text[a:e]) for a, e in halves(len(text), self.text_leaf)], self.join_pieces)

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        """Pieces of two split texts' concatenation."""
        at, near = len(left), 0
        while at and near < REACH:
            at -= 1
            near += len(left[at])
        tail, size = "".join(left[at:]), WINDOW
        while True:
            head = right[:size]
            text, whole = tail + "".join(head), size >= len(right)
            known = len(text) if whole else len(text) - REACH
            borders = dict(zip(accumulate(map(len, head), initial=len(tail)), range(len(head) + 1), strict=True))
            new = self.pieces(text)
            for n, end in enumerate(accumulate(map(len, new)), 1):
                if end > known:
                    break
                if end in borders:
                    return left[:at] + new[:n] + right[borders[end] :]
            size *= 2

    def encode_piece(self, raw: bytes) -> list[int]:
        if len(raw) <= self.leaf:
            return self.merge(raw)
        with ThreadPoolExecutor(self.threads) as pool:
            parts = list(pool.map(lambda s: self.merge(raw[s[0] : s[1]]), halves(len(raw), self.leaf)))
        return tree(parts, self.join)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two encoded texts' concatenation."""
        size = WINDOW
        while True:
            a, b = left[-size:], right[:size]
            raw = b"".join(self.bytes_of[i] for i in (*a, *b))
            new = self.merge(raw)
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if (whole_left or new[0] == a[0]) and (whole_right or new[-1] == b[-1]) and (len(new) > 1 or (whole_left and whole_right)):
                return left[: len(left) - len(a)] + new + right[len(b) :]
            size *= 2

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.split_added and any(t in text for t in self.added):
            return b"".join(np.array([self.added[x]], dtype="<u4").tobytes() if x in self.added else self.encode_plain(x) for x in self.split_added.split(text) if x)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and n_tokens, ids (binary), decoded (string) for each row of docs (column text)."""
    tune(docs.sparkSession)
    path = path or default_path()
    docs = docs.select(*keep, F.col("text").cast("string").alias("_scanned"))
    out = T.StructType([*docs.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for chunk in K.chunks(b, len(keep)):
                ids = [c.encode(t) if t else b"" for t in chunk.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*chunk.columns[: len(keep)], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.string())],
                    [*keep, "n_tokens", "ids", "decoded"],
                )

    return docs.mapInArrow(K.lean(run), out)
