"""Spans (kind, start, end) in code points, shared by the scanning operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
FIELDS = "kind string, start int, end int"
DDL = "array<struct<kind:string,start:int,end:int>>"


def ordered(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> list[dict]:
    """By start, then by the kinds' order."""
    rank = {k: i for i, k in enumerate(kinds)}
    return [{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2]))]


def text_of(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
