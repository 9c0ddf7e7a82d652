"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where that is unset, a folder of this machine will do only if the executors run in the driver's own process (tests);
    elsewhere they would write to disks the others can't read, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str = "graph", by: list[str] | None = None, lies: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs survive lost executors and never recompute it.

    by: columns whose hash deals the rows over as many buckets as there are shuffle partitions.  What joins or groups by these columns
    then takes the rows as they lie; only the other side moves.  Loops read such a table in every step and never shuffle it again.
    lies: df is dealt by these columns already, so it is written where it is (were it not, the table would only have more files)."""
    spark = df.sparkSession
    table = f"riskloom_{re.sub(r'[^a-z0-9]', '_', name.lower())}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table.replace('_', '-')}"
    if by:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        (df if lies else df.repartition(*by)).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, *by).saveAsTable(table)
    else:
        df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.table(table) if by else spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def joined_in_place(spark: SparkSession):
    """Within it, a join on more columns than those that deal both of its sides takes them as they lie; else Spark moves both again.
    Only what is written within it gains, as plans are made when they run."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Seen:
    """Rows that a loop has met, in bucketed tables: new ones are told by joins with the tables as they lie, so no step moves or sorts what earlier
    steps found; a task holds its part of the new rows, and what was met streams by.  Beyond MOST tables all but the largest become one."""

    MOST = 8

    def __init__(self, keys: list[str], by: list[str] | None = None):
        """by: the keys that deal the rows, if these are not all of them."""
        self.keys, self.by, self.parts = keys, by or keys, []

    def without(self, rows: DataFrame) -> DataFrame:
        """rows (one for each of the keys) that were not met yet."""
        for _, part in self.parts:
            rows = rows.hint("shuffle_hash").join(part.withColumn("_met", F.lit(True)), self.keys, "left").where("_met IS NULL").drop("_met")
        return rows

    def add(self, part: DataFrame, n: int) -> None:
        """part: n rows of a table that is bucketed by ``by``."""
        self.parts.append((n, part.select(*self.keys)))
        if len(self.parts) > self.MOST:
            self.parts.sort(key=lambda x: -x[0])
            some = self.parts[1:]
            rest = some[0][1]
            for _, part in some[1:]:
                rest = rest.unionAll(part)
            self.parts = [self.parts[0], (sum(n for n, _ in some), cut(rest, "seen", self.by))]
