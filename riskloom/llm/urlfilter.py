"""URL filters by a sort-merge range join with nested rules.

A rule's host, labels reversed and each closed by a dot (``example.net`` -> ``net.example.``), is a prefix
of the keys of that host and all its subdomains, that is, an interval of sorted keys.  Such intervals are
laminar: two are nested or apart.

Urls and rules are dealt to parts by range of (key, hash of the row), and sorted within a part.  The borders come from a
bounded sample of the urls (``PER_PART`` rows a part): they decide how even the parts are, never the result.  A host with
a third of all urls spans many parts.  A url goes to one part, a rule to every part that its interval meets: to the one or
few its host lies in, and to those that begin below it, at most as many as a border key has labels.  Each part is then one
merge: a sweep over its sorted rows keeps a stack of the rules' hosts that are active, pops what a key has left behind, and
asks the path rules of the active hosts.  Rules are never collected; there is one plan for any number of them.

host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to
``?``, ``#`` or the end; null or no ``://``: both empty.  Without a rule the verdict is ``allow``.

Edge cases: the longest rule (host and path together) wins; of equally long ones block wins over allow, then the longer host.
A null rule host or path counts as empty; a rule with an empty host fits no url.  Repeated urls and rows, null ids and other
columns change nothing; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import partitions, tune

#: Urls sampled for each part, to place the borders.
PER_PART = 64
LEAST = -(1 << 63)


def host_of(url: str) -> Column:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: str) -> str:
    return "".join(label + "." for label in reversed(host.split("."))) if host else ""


class Active:
    """The rules of one active host: verdicts by path, and the paths' lengths, longest first."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.lengths = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        if path not in self.paths and len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)
        self.paths[path] = "block" if "block" in (verdict, self.paths.get(path)) else verdict

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if path[:n] in self.paths), None)


class Sweep:
    """One pass over the sorted rows of a part, with a stack of the active hosts."""

    def __init__(self):
        self.part, self.stack = None, []

    def leave(self, part: int, key: str) -> None:
        if part != self.part:
            self.part, self.stack = part, []
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def rule(self, part: int, key: str, host: str, path: str, verdict: str) -> None:
        self.leave(part, key)
        if not self.stack or self.stack[-1].key != key:
            self.stack.append(Active(key, host))
        self.stack[-1].add(path, verdict)

    def ask(self, part: int, key: str, path: str) -> tuple[str | None, str | None]:
        self.leave(part, key)
        best, out = None, (None, None)
        for active in self.stack:
            found = active.longest(path)
            if found is not None:
                rank = (len(active.host) + len(found), active.paths[found] == "block", len(active.host))
                if best is None or rank > best:
                    best, out = rank, (active.host + found, active.paths[found])
        return out


def borders(urls: DataFrame, parts: int) -> list[tuple[str, int]]:
    """Sorted (key, salt) borders of the parts, from about PER_PART urls a part."""
    n = urls.count() if parts > 1 else 0
    if not n:
        return []
    some = urls.sample(min(1.0, PER_PART * parts / n), seed=7).select("host", "salt").toArrow()
    seen = sorted((key_of(h), x) for h, x in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True))
    return sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", key: str = "page_id", parts: int | None = None) -> DataFrame:
    """key, host, path, rule, verdict for each row of pages; rules has host, path, verdict (block or allow)."""
    tune(pages.sparkSession)
    parts = parts or partitions(pages.select(key, url))
    urls = pages.select(F.col(key).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64(F.col(key).cast("string"), url).alias("salt"))
    rules = rules.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path", "verdict")]).where("host <> ''")
    edge = borders(urls, parts)
    starts = [k for k, _ in edge]
    kind = urls.schema["id"].dataType.simpleString()
    schema = f"part int, key string, verdict string, salt long, id {kind}, host string, path string"
    arrow = pa.schema([("part", pa.int32()), ("key", pa.string()), ("verdict", pa.string()), ("salt", pa.int64())])

    def place_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, salts = [key_of(h) for h in b.column(1).to_pylist()], b.column(3).to_pylist()
            part = [bisect_right(edge, x) for x in zip(keys, salts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys, pa.string()), pa.nulls(len(keys), pa.string()), b.column(3), b.column(0), b.column(1), b.column(2)], [*arrow.names, "id", "host", "path"])

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for host, path, verdict in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = key_of(host)
                # from the part that holds the first key of the interval to that of its last
                first, last = bisect_left(edge, (k, LEAST)), bisect_left(starts, k[:-1] + "/")  # "/" follows the closing dot
                for lo in range(first, last + 1, 4096):
                    n = min(4096, last + 1 - lo)
                    yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + n), pa.int32()), pa.array([k] * n), pa.array([verdict] * n), pa.array([LEAST] * n, pa.int64()), pa.array([host] * n), pa.array([path] * n)], [*arrow.names, "host", "path"])

    placed = rules.mapInArrow(K.lean(place_rules), "part int, key string, verdict string, salt long, host string, path string")
    placed = placed.select("part", "key", "verdict", "salt", F.lit(None).cast(kind).alias("id"), "host", "path")
    both = urls.mapInArrow(K.lean(place_urls), schema).unionAll(placed)
    # a rule stands before the urls of its own key: it has a verdict, they have none
    both = both.repartition(parts, "part").sortWithinPartitions("part", "key", F.col("verdict").desc_nulls_last(), "salt")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep()
        for b in batches:
            is_url, rule, verdict = [], [], []
            for part, k, what, host, path in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 5, 6)), strict=True):
                is_url.append(what is None)
                if what is None:
                    found, says = sweep.ask(part, k, path)
                    rule.append(found)
                    verdict.append(says or default)
                else:
                    sweep.rule(part, k, host, path, what)
            out = b.select([4, 5, 6]).filter(pa.array(is_url, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [key, "host", "path", "rule", "verdict"])

    return both.mapInArrow(K.lean(merge), f"`{key}` {kind}, host string, path string, rule string, verdict string")
