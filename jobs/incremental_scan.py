"""Job 1: rule hits of new documents, as an incremental scan of a growing table.

    spark-submit jobs/incremental_scan.py --documents IN --output OUT --checkpoint MARK [--config FILE]

A file stream takes the files of IN that the checkpoint does not know yet (availableNow: what is there, then it ends).  Each micro-batch
is split into lines, tried against all rules, cleared of what is out of scope or excluded by its path, and merged to one
candidate for each place; candidates that an earlier batch has written are left out, the rest goes to OUT, partitioned by ``batch``
and ``source``.

Reruns.  A batch is written by dynamic partition overwrite under its own number: if a run dies after the write and before the mark, the
next one takes the same files under the same number, compares with earlier batches only, and replaces what is there.  A run without
new files writes nothing.  OUT and MARK belong together: a new MARK needs a new OUT.

What counts.  A document is its source, language and doc_id.  One that is delivered again with the same lines adds nothing; of one that
comes with other text, places that are known stay as they are and new ones are added.  Within a batch, rules that hit one place
are one candidate.  Null texts have no lines; a null source, lang or doc_id is blank in the file's name, and a null or blank source is Spark's
default partition.  Columns are read from
IN's files, a folder's own or a single one, not from names of folders; further columns are ignored.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from jobs.common import beside, config, log, made, main, spread  # noqa: E402
from riskloom.functions import scalars as X  # noqa: E402
from riskloom.operators import candidates as C  # noqa: E402
from riskloom.sources import bridge as B  # noqa: E402

#: Files of a micro-batch at most; files that a batch writes for each source at most; weakness classes and paths that are left out.
DEFAULTS = {"files_per_batch": 1000, "files_per_source": 8, "out_of_scope": [], "exclude_paths": []}
BY = ("batch", "source")
INPUT = "doc_id long, text string, lang string, source string"
SCHEMA = T.StructType([
    T.StructField("dedup_key", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("rule_id", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("cwe_ids", T.ArrayType(T.StringType())), T.StructField("rule_ids", T.ArrayType(T.StringType())), T.StructField("messages", T.ArrayType(T.StringType())),
    T.StructField("verification_mode", T.StringType()), T.StructField("confidence", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("source", T.StringType()),
])


def scanned(docs: DataFrame, settings: dict) -> DataFrame:
    """Candidates of documents, one for each place, in the columns of the output but ``batch``."""
    found = C.drop_out_of_scope(B.candidates_of(B.hits_of(B.lines_of(docs))), settings["out_of_scope"])
    if settings["exclude_paths"]:
        found = C.drop_excluded_paths(found, settings["exclude_paths"])
    return C.dedup(found).select(
        "dedup_key", "doc_id", F.col("sink_file").alias("file"), F.col("sink_line").alias("line"), "rule_id", "severity", X.cwe_ids(F.col("cwe")).alias("cwe_ids"),
        "rule_ids", "messages", "verification_mode", "confidence", F.col("report_id").alias("source"),
    )


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(output)


def watched(path: str) -> str:
    """The path as a pattern that only it fits: Spark's file stream takes a folder by its name, but a single file only by a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict | None = None) -> dict:
    """Scan the documents that are new since the last run; returns what was read and written."""
    settings = DEFAULTS | (settings if settings is not None else config(beside(__file__), DEFAULTS))
    made(spark, output, SCHEMA, BY)
    told = {"batches": 0, "documents": 0, "candidates": 0}

    def batch(docs: DataFrame, number: int) -> None:
        own = docs.sparkSession
        known = read(own, output).where(F.col("batch") < number).select("dedup_key")
        new = scanned(docs, settings).join(known, "dedup_key", "left_anti")
        out = new.withColumn("batch", F.lit(number).cast("long")).select(*SCHEMA.names)
        spread(out, BY, "dedup_key", settings["files_per_source"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BY).parquet(output)
        seen, put = docs.count(), read(own, output).where(F.col("batch") == number).count()  # of the files' footers and of one folder
        told["batches"] += 1
        told["documents"] += seen
        told["candidates"] += put
        log.info("batch %d: read %d documents of %s, wrote %d candidates to %s", number, seen, documents, put, output)

    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(watched(documents))
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %d batches, %d documents read, %d candidates written", output, told["batches"], told["documents"], told["candidates"])
    return told


if __name__ == "__main__":
    main(run, DEFAULTS, ("documents", "output", "checkpoint"), __file__)
