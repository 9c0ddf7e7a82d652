"""What both jobs share: the command line, the config file, the session, the log."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

log = logging.getLogger("riskloom.jobs")


def config(path: str, known: dict) -> dict:
    """Settings of a small JSON file over the defaults in known; a name that is not there is an error."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    if odd := sorted(set(own) - set(known)):
        raise ValueError(f"{path}: unknown settings {', '.join(odd)}")
    return known | own


def beside(module_file: str) -> str:
    """The config file that is shipped with a job."""
    return os.path.splitext(module_file)[0] + ".json"


def made(spark: SparkSession, path: str, schema: StructType, by: tuple[str, ...]) -> DataFrame:
    """The table at path, which is created where it is not there; nothing is added to one that is."""
    spark.createDataFrame([], schema).write.partitionBy(*by).mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame, by: tuple[str, ...], key: str, files: int) -> DataFrame:
    """df dealt for a partitioned write: at most so many files for each folder, so that a folder with a third of all rows
    is no single task and a small one no thousand files."""
    return df.repartition(*by, F.pmod(F.xxhash64(key), F.lit(files)))


def main(run: Callable, defaults: dict, paths: tuple[str, ...], module_file: str, argv: list[str] | None = None) -> None:
    """Command line: one option for each path, and --config.  Only here is a session made and stopped."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    p = argparse.ArgumentParser(description=run.__doc__)
    for name in paths:
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=beside(module_file))
    args = vars(p.parse_args(argv))
    settings = config(args.pop("config"), defaults)
    spark = SparkSession.builder.appName(os.path.basename(module_file)).getOrCreate()
    try:
        run(spark, settings=settings, **args)
    finally:
        spark.stop()
