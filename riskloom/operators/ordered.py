"""Ranks and running totals within groups of any size, without gathering a group in one task.

Rows are dealt by range of (group, order), written once with the number of their range, ranked within each range, and
shifted by what the group has in the ranges before: a table of one row for each range and group in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut


def ranked(df: DataFrame, group: list[str], order: list[Column], rank: str = "place", totals: dict[str, str] | None = None) -> DataFrame:
    """df with the row's rank in its group (from 1), and for each name in totals the running sum of that column up to the row.
    The order must be total within a group."""
    totals = totals or {}
    spark = df.sparkSession
    keys = [f"_o{i}" for i in range(len(order))]
    held = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    dealt = held.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *group, *keys)
    dealt = cut(dealt.withColumn("_range", F.spark_partition_id()))
    here = Window.partitionBy("_range", *group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", F.count(F.lit(1)).over(here).alias(rank), *[F.sum(c).over(here).alias(n) for n, c in totals.items()])
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = dealt.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{n}") for n, c in totals.items()])
    shift = each.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), *[F.coalesce(F.sum(f"_s_{n}").over(ahead), F.lit(0)).alias(f"_b_{n}") for n in totals])
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = out.join(shift, same).withColumn(rank, F.col(rank) + F.col("_before"))
    for n in totals:
        out = out.withColumn(n, F.coalesce(n, F.lit(0)) + F.col(f"_b_{n}"))
    return out.select(*df.columns, rank, *totals)


def last_value(df: DataFrame, group: list[str], order: list[Column], value: str, name: str, ahead: bool = False) -> DataFrame:
    """df with, under name, the last value that is not null in its group up to the row (ahead: of the rows before it).  The order must be
    total within a group for a defined result; a group of any size is spread over ranges, as in ``ranked``."""
    spark = df.sparkSession
    keys = [f"_o{i}" for i in range(len(order))]
    held = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    dealt = held.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *group, *keys)
    dealt = cut(dealt.withColumn("_range", F.spark_partition_id()))
    here = Window.partitionBy("_range", *group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1 if ahead else 0)
    out = dealt.select("*", F.last(value, ignorenulls=True).over(here).alias(name))
    each = dealt.groupBy("_range", *group).agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*keys))).alias("_last"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = each.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = out.join(carry, same).withColumn(name, F.coalesce(name, "_carried"))
    return out.select(*df.columns, name)
