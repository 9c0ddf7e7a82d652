"""Token counts: batch encoding inside Arrow functions that return lengths only.

Rows come in chunks of about a megabyte of text (``textkernel.chunks``), whatever their lengths.  Texts are split at safe boundaries, so a
long one is many short segments; segments that a worker has not met are encoded by the library in batches of ``BATCH`` bytes,
and a text's count is the sum of its segments'.  Ids never leave the library's call.

A boundary is safe where no token can span it and neither side's tokens depend on the other:

* **Byte-level vocabularies** (.json) whose pre-tokenizer is the byte-level pattern: in front of a blank that follows a letter, a digit
  or an ASCII sign.  No piece of the pattern goes on from such a character to a blank, and only white space looks ahead.
  Added tokens that hold a blank or swallow blanks beside them forbid it.
* **SentencePiece models** (.model) that put a blank before a text and have no piece with a blank inside: at a single blank between such
  characters, which itself goes, as the right side gets its own.
* With any other file texts are encoded whole.

Edge cases: null is an empty text (no bytes, no tokens); a text without a safe boundary is one segment, however long; special strings inside
texts are handled as the library does by default.  Repeated rows and null ids are counted row by row, an empty table gives
an empty result, and other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .bpe import default_path
from .common import tune

LIMIT = 1024
#: Bytes of text handed to the library at once; characters of a segment that is remembered, and how many are.
BATCH, SHORT, CACHE = 256 << 10, 48, 500_000


def _solid(c: str) -> bool:
    """A letter, a digit or an ASCII sign: white space in nobody's eyes."""
    return c.isalnum() or "!" <= c <= "~"


class Counter:
    """Token counts of texts by one vocabulary file."""

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            batch = getattr(t, "encode_batch_fast", t.encode_batch)
            self.encode = lambda texts: [len(x) for x in batch(texts, add_special_tokens=False)]
            pre = spec.get("pre_tokenizer") or {}
            plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
            added = [x for x in spec.get("added_tokens", []) if x["lstrip"] or x["rstrip"] or x["single_word"] or any(c.isspace() for c in x["content"])]
            self.splits, self.lead = plain and not added, " "
        elif path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            m = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in m.encode(texts, num_threads=1)]
            inside = any("▁" in m.id_to_piece(i).strip("▁") or m.id_to_piece(i).rstrip("▁") not in ("", m.id_to_piece(i)) for i in range(m.get_piece_size()))
            self.splits, self.lead = not inside and m.encode("ab cd") == m.encode("ab") + m.encode("cd"), ""
        else:
            raise ValueError(f"{path}: a .json or .model file is asked for")

    def segments(self, text: str) -> list[str]:
        """The text, cut at its safe boundaries."""
        if not self.splits:
            return [text]
        out, parts = [], text.split(" ")
        now = parts[0]
        for p in parts[1:]:
            if now and _solid(now[-1]) and (self.lead or (p and _solid(p[0]))):
                out.append(now)
                now = self.lead + p
            else:
                now = f"{now} {p}"
        out.append(now)
        return out

    def count(self, texts: list[str]) -> list[int]:
        each = [self.segments(t) if t else [] for t in texts]
        known = self.known
        new = list({s for e in each for s in e if s not in known})
        lengths: dict[str, int] = {}
        batch, size = [], 0
        for i, s in enumerate(new):
            batch.append(s)
            size += len(s)
            if size >= BATCH or i + 1 == len(new):
                lengths.update(zip(batch, self.encode(batch), strict=True))
                batch, size = [], 0
        if len(known) + len(lengths) > CACHE:
            lengths.update((s, known[s]) for e in each for s in e if s in known)
            known.clear()
        known.update(lengths)
        out = [sum(map(known.__getitem__, e)) for e in each]
        for s in lengths:
            if len(s) > SHORT:
                del known[s]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_count(docs: DataFrame, path: str | None = None, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_bytes (UTF-8), n_tokens and over_limit for each row of docs (column text)."""
    tune(docs.sparkSession)
    path = path or default_path()
    docs = docs.select(*keep, F.col("text").cast("string").alias("_scanned"))
    out = T.StructType([*docs.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            for chunk in K.chunks(b, len(keep)):
                texts = [t or "" for t in chunk.column(len(keep)).to_pylist()]
                size = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([*chunk.columns[: len(keep)], pa.array(size, pa.int64()), pa.array(c.count(texts), pa.int64())], [*keep, "n_bytes", "n_tokens"])

    return docs.mapInArrow(K.lean(run), out).withColumn("over_limit", F.col("n_tokens") > limit)
