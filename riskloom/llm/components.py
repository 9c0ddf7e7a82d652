"""Connected components of an edge table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups

#: Beyond so many supersteps the input is no graph of this kind; an error is better than a wrong answer.
MAX_STEPS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b).

    Alternates large-star and small-star contractions; each is one aggregation (minimum of a node's
    neighbours, combined before the shuffle) and one join that splits hubs off, and the number of rounds grows with the
    logarithm of a component's diameter.  Nothing but counts reaches the driver.
    Null ends and loops are ignored; repeated edges count once; an empty table gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = cut(e, "edges")
    total = e.count()
    for _ in range(MAX_STEPS if total else 0):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        large = join_groups(both.where("v > u"), low, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        # written, as the next join asks for it five times, and a plan that holds it as often costs the driver more than its rows
        large = cut(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        step = join_groups(large, low, "u", total)
        new = step.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(new, "edges")
        # a star forest is a fixed point: every node has one neighbour below it, and that one has none
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        total, open_ = ends.agg(F.sum("up"), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()
        if not open_:
            break
    else:
        if total:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
