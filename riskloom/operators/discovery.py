"""Ordered breadth-first search: who calls a method, level by level, in the order in which one would come upon it.

A superstep carries for each (sink, node) the list of call numbers that leads to it.  Lists of one level are of one length and compare
element by element, so their minimum is the discovery order: parents in their own order first, then calls in theirs.  No window over
a level is needed, and the list is the chain itself.  Each level is written to the shared folder; the driver only asks whether it is empty.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut

#: Beyond so many levels a search is an error, not an answer.
MOST = 10_000


def levels(starts: DataFrame, edges: DataFrame, stop: DataFrame | None = None, max_depth: int | None = None, cap: int | None = None) -> DataFrame:
    """sink, node, depth, chain, open: all nodes from which a start (sink, node) is reached over edges (caller, callee, seq).

    Each node counts once for a sink, at its least depth and by its first chain (call numbers, the nearest to the sink first).  Nodes in
    stop (node) are not searched beyond, unless they are the start.  cap: a sink's search ends with the level at which it has seen so many
    nodes; ``open`` is false for a level that was not searched any more.  Loops and repeated edges add nothing; an unknown start is the only
    node of its sink, and no starts give no rows."""
    edges = cut(edges.groupBy(F.col("callee").alias("node"), "caller").agg(F.min("seq").cast("bigint").alias("seq")), "edges")
    now = starts.select("sink", "node").distinct().withColumn("chain", F.array().cast("array<bigint>"))
    found, visited = [], None
    for depth in range(MOST):
        now = cut(now, "level")
        if depth and now.isEmpty():
            break
        own = now.select("sink", "node")
        visited = own if visited is None else visited.unionAll(own)
        if cap is None:
            now = now.withColumn("open", F.lit(True))
        else:
            full = visited.groupBy("sink").agg(F.count("*").alias("n")).where(F.col("n") >= cap).select("sink", F.lit(False).alias("open"))
            now = cut(now.join(full, "sink", "left").withColumn("open", F.coalesce("open", F.lit(True))), "level")
        found.append(now.withColumn("depth", F.lit(depth)))
        if depth == max_depth:
            break
        frontier = now.where("open")
        if stop is not None and depth:
            frontier = frontier.join(stop.select("node").distinct(), "node", "left_anti")
        step = frontier.join(edges, "node").groupBy("sink", F.col("caller").alias("node")).agg(F.min(F.concat("chain", F.array("seq"))).alias("chain"))
        now = step.join(visited, ["sink", "node"], "left_anti")
    else:
        raise RuntimeError("the search did not come to an end")
    return functools.reduce(DataFrame.unionAll, found).select("sink", "node", "depth", "chain", "open")


def chains(sinks: DataFrame, edges: DataFrame, entries: DataFrame, max_depth: int = 20) -> DataFrame:
    """sink, entry, depth, chain, place: the chain of calls from each entry that reaches a sink (sink, node), shortest first, equally long
    ones in discovery order; place counts from 1.

    entries: node, definitive.  A sink in a proven entry has itself at depth 0 and nothing else; one in an entry that is only hinted at is
    searched, and has itself if nothing reaches it.  An entry is not searched beyond."""
    entries = cut(entries.groupBy("node").agg(F.max("definitive").alias("definitive")), "entries")
    starts = cut(sinks.select("sink", "node").distinct().join(entries, "node", "left"), "starts")
    itself = lambda df: df.select("sink", F.col("node").alias("entry"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("chain"))
    seen = levels(starts.where("definitive IS NOT TRUE"), edges, entries, max_depth)
    found = seen.where("depth > 0").join(entries.select("node"), "node", "left_semi").select("sink", F.col("node").alias("entry"), "depth", "chain")
    found = cut(found, "chains")
    hinted = starts.where("NOT definitive").join(found.select("sink").distinct(), "sink", "left_anti")
    place = F.row_number().over(Window.partitionBy("sink").orderBy("depth", "chain"))
    return found.unionAll(itself(starts.where("definitive"))).unionAll(itself(hinted)).withColumn("place", place)


def ends(starts: DataFrame, edges: DataFrame, cap: int | None = 200) -> DataFrame:
    """start, leaf, depth, chain: where the calls that lead to a start (start, node) begin, i.e. nodes that nothing but themselves calls, in
    the levels that were searched before a start had seen cap nodes (None: in all).  A start that nothing calls is its own end; one that only loops
    lead to has none."""
    edges = cut(edges.where("caller <> callee"), "edges")
    seen = levels(starts.select(F.col("start").alias("sink"), "node"), edges, cap=cap)
    return seen.where("open").join(edges.select(F.col("callee").alias("node")).distinct(), "node", "left_anti").select(F.col("sink").alias("start"), F.col("node").alias("leaf"), "depth", "chain")
