"""Scan and configuration tables: status predicates, active configuration, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(scans: DataFrame, states: list[str]) -> DataFrame:
    return scans.where(F.col("status").isin(states))


def interrupted(scans: DataFrame, states: list[str]) -> DataFrame:
    """Scans as they stand after a restart: what was running has failed."""
    return scans.withColumn("status", F.when(F.col("status").isin(states), "failed").otherwise(F.col("status")))


def active_config(configs: DataFrame, key: str) -> DataFrame:
    """For each key the configuration in use: the active one, else the most recent."""
    return configs.groupBy(key).agg(F.max_by("config_id", F.struct(F.col("is_active").cast("int"), "created_at", "config_id")).alias("config_id"))


def newest(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n newest rows of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("id")))
    return rows.withColumn("place", place).where(F.col("place") <= n)
