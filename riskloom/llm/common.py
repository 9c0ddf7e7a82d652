"""Session helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut, shared_dir

__all__ = ["cut", "input_bytes", "join_groups", "left_join_known", "partitions", "shared_dir", "small", "tune"]

#: Rows of an Arrow batch handed to Python: long texts must not add up to a huge batch.
ARROW_ROWS = "512"
#: Bytes of input for which one more shuffle partition is asked.
BYTES_PER_PARTITION = 64 << 20


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the tables that df reads; 0 for those of unknown size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions: the session's number, or more where the input asks for it."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // BYTES_PER_PARTITION)


def small(df: DataFrame, rows: int) -> bool:
    """True if df has at most so many rows (reads no more than that)."""
    return df.limit(rows + 1).count() <= rows


def left_join_known(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the columns of right (one row a key), by a sort-merge join at every size.  Rows without a key match
    nothing and stay where they are: however many, they are no hot task."""
    added = [f for f in right.schema.fields if f.name != key]
    known = left.where(F.col(key).isNotNull()).join(right.hint("merge"), key, "left").select(*left.columns, *[f.name for f in added])
    return known.unionAll(left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added]))


#: A key with more than one in HEAVY of the rows (and more than LEAST of them) is joined by broadcast.
HEAVY, LEAST = 1000, 16


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """rows joined with groups, which has one row a key and in its column ``n`` how many of the rows have that key.

    Keys of more than a HEAVY-th of all rows are at most HEAVY, whatever the data: they are joined by broadcast, so that no
    key is a hot task; all others meet by a shuffle.  ``n`` is dropped.  Rows without a partner are dropped.  total: how many
    rows there are, where that is known.
    """
    least = max(LEAST, (rows.count() if total is None else total) // HEAVY)
    heavy = groups.where(F.col("n") > least).drop("n")
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(groups.where(F.col("n") <= least).drop("n"), key)
    return hot.unionByName(rest)
