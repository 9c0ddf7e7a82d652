"""PII by fixed patterns and bootstrapped contextual extraction.

Base kinds, leftmost and non-overlapping per kind, failing matches dropped without retries: ``email``,
``ip`` (four parts of at most 255), ``card`` (14 to 19 digits, Luhn), ``phone`` (+ and 10 to 15 digits).

Bootstrap.  The base entities are seeds.  Every entity-like string (digits with separators, or a string
with an @) outside them is a candidate instance.  Patterns are lexical: the sort of an instance (number or
mail) with the word before it, with the word after it, and with both; its shape is no part of them, so candidates of
shapes that no seed has are found in the seeds' contexts.  Spark scores the pattern - instance graph in ``ROUNDS``
rounds: a pattern's confidence is the share of trusted weight among its instances, damped by its support; an
instance's trust is the noisy-or of its accepted patterns, those with confidence of at least ``CONFIDENT`` and support
of at least ``SUPPORT`` distinct instances (others pass no trust on, else words as common as "the" would confirm
themselves).  Candidates of accepted patterns become spans of kind ``context``.

The graph is grouped by hashes of patterns and instances, with sums combined before each shuffle; joins split off the
patterns and instances that hold more than a small share of all rows, so none is a hot task.  The candidates of a document
travel without its text.  Scanning is linear in a text's length, whatever runs of digits, letters or signs it has.

Edge cases: null is an empty text without spans.  Repeated rows and null ids are rows like others (each row
gets its own result; repeated instances count once).  An empty table gives an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import cut, join_groups, tune
from .spans import DDL, TYPE, ordered

KINDS = ("email", "ip", "card", "phone", "context")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
AT_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
# a match never begins within a run of digits: what fails from the run's start fails from any digit of it
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"[+(]?[0-9][0-9().\x20/-]{5,}[0-9]")
MAIL = re.compile(r"(?<![^\x20\x09-\x0D@])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++")
BEFORE, AFTER = re.compile(r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$"), re.compile(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)")
ROUNDS = 3
CONFIDENT, SUPPORT = 0.8, 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _at_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Runs of non-blanks with an @."""
    e, at = 0, text.find("@")
    while at >= 0:
        a = max(text.rfind(c, e, at) for c in " \t\n\x0b\f\r")
        a = e if a < 0 else a + 1
        e = AT_TOKEN.match(text, a).end()
        yield a, e
        at = text.find("@", e)


def emails(text: str) -> list[tuple[str, int, int]]:
    """Each @ with a domain behind it, back to where its local part or the match before it ends: what leftmost matching finds."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                out.append(("email", start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = emails(text)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 if len(p) < 9 else int(p.lstrip("0")[:9] or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


def _id(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def patterns(what: str, before: str, after: str) -> list[int]:
    """Hashes of an instance's left, right and two-sided contexts, as far as there are words."""
    sort = "mail" if "@" in what else "number"
    out = [_id("left", sort, before)] if before else []
    out += [_id("right", sort, after)] if after else []
    return out + ([_id("both", sort, before, after)] if before and after else [])


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and candidates: start, end, seed, and hashes of patterns and instance."""
    out = []
    taken = sorted((s, e) for _, s, e in base)
    found = [(s, e, 1) for s, e in taken]
    like = [m.span() for m in NUMBER.finditer(text)] + [m.span() for a, e in _at_tokens(text) for m in MAIL.finditer(text, a, e)]
    if like:
        starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        for s, e in like:  # those that overlap no seed
            before = bisect_left(starts, e)
            if not before or ends[before - 1] <= s:
                found.append((s, e, 0))
    for s, e, seed in found:
        before, after = BEFORE.search(text, max(0, s - 64), s), AFTER.match(text, e, e + 64)
        context = (before[1].lower() if before else "", after[1].lower() if after else "")
        what = text[s:e]
        out.append({"start": s, "end": e, "seed": seed, "patterns": patterns(what, *context), "instance": _id(what.lower())})
    return out


MENTION = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.int32()), ("patterns", pa.list_(pa.int64())), ("instance", pa.int64())]))


def pii_scan(docs: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """doc_id, base, spans (arrays of kind, start, end; spans: base and context) for each row of docs (columns doc_id, text)."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() << 36) - 1
        for b in batches:
            for chunk in K.chunks(b):
                keys, base, seen = [], [], []
                for text in chunk.column(1).to_pylist():
                    row += 1
                    found = base_spans(text) if text else []
                    keys.append(row)
                    base.append(ordered(found, KINDS))
                    seen.append(mentions(text, found) if text else [])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), chunk.column(0), pa.array(base, TYPE), pa.array(seen, MENTION)], ["row", "doc_id", "base", "mentions"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(docs.mapInArrow(K.lean(run), f"row long, doc_id {kind}, base {DDL}, mentions array<struct<start:int,end:int,seed:int,patterns:array<long>,instance:long>>"), "mentions")
    each = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    each = each.withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = cut(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph")
    total = edges.count()
    trusted = cut(edges.groupBy("instance").agg(F.max("seed").cast("double").alias("trust"), F.count("*").alias("n")), "trust")
    for _ in range(rounds):
        scored = join_groups(edges, trusted, "instance", total).groupBy("pattern").agg(F.sum("trust").alias("good"), F.count("*").alias("n"))
        scored = scored.select("pattern", (F.col("good") / (F.col("n") + 0.25)).alias("confidence"), "n")
        good = cut(scored.where((F.col("confidence") >= confident) & (F.col("n") >= support)), "good")
        spread = join_groups(edges, good, "pattern", total).groupBy("instance")
        spread = spread.agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("noisy"), F.max("seed").alias("seed"))
        spread = spread.select("instance", F.when(F.col("seed") == 1, 1.0).otherwise(F.col("noisy")).alias("new"))
        trusted = cut(trusted.join(spread, "instance", "left").select("instance", F.greatest("trust", F.coalesce("new", F.lit(0.0))).alias("trust"), "n"), "trust")
    open_ = each.where("seed = 0")
    found = open_.groupBy("pattern").agg(F.count("*").alias("n")).join(good.select("pattern"), "pattern")
    more = join_groups(open_, found, "pattern").groupBy("row").agg(F.collect_set(F.struct(F.lit("context").alias("kind"), "start", "end")).alias("more"))
    out = rows.drop("mentions").join(more, "row", "left")
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    order = lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise((rank(x) - rank(y)).cast("int"))
    both = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"), order))
    return out.select("doc_id", "base", both.alias("spans"))
