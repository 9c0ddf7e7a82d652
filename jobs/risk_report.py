"""Job 2: risk reports of all documents, or of some sources.

    spark-submit jobs/risk_report.py --documents IN --labels LABELS --output OUT [--config FILE]

Documents are scanned for rule hits; hits are cleared of what is out of scope, merged to one finding for each place, and over copies of a
file to the first; a document's label is its verdict, and score and risk follow from weakness class and verdict.  OUT is partitioned
by ``report_id`` (the source) and holds, by ``kind``:

* ``finding``: the findings, ``place`` in reading order (reachable first, then by severity), ``n`` how many copies it stands for;
* ``rule``: for each rule its hits ``n``, most first;
* ``verdict`` and ``risk``: how many findings have each verdict and risk level, zeros included.

Reruns.  The result depends on the input alone.  With ``sources`` in the config only those reports are made anew (dynamic partition
overwrite; a report always has its verdict rows, so nothing old is left in it), others stay; without, all of OUT is written anew,
and reports of sources that are gone go too.  With ``sources``, copies in other sources still count: who is first does not depend on
what is asked for.

What counts.  Null texts have no findings; a document without label is unverified, one with several labels gives a finding for each of
them, placed in the order of their verdicts; one without doc_id has no label; rows of equal source, language and doc_id are one file.  A
null or blank source is Spark's default partition.  Further columns are ignored.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from jobs.common import beside, config, log, main, spread  # noqa: E402
from riskloom.functions import scalars as X  # noqa: E402
from riskloom.functions.storage import cut  # noqa: E402
from riskloom.operators import analytics as A  # noqa: E402
from riskloom.operators import candidates as C  # noqa: E402
from riskloom.operators.ordered import ranked  # noqa: E402
from riskloom.sources import bridge as B  # noqa: E402

#: Sources whose reports are made (none named: all); files for each report at most; weakness classes and paths that are left out.
DEFAULTS = {"sources": [], "files_per_report": 8, "out_of_scope": [], "exclude_paths": []}
BY = ("report_id",)
SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("place", T.LongType()), T.StructField("item", T.StringType()), T.StructField("rules", T.StringType()), T.StructField("verdict", T.StringType()),
    T.StructField("risk_level", T.StringType()), T.StructField("cvss_vector", T.StringType()), T.StructField("cvss_score", T.StringType()), T.StructField("n", T.LongType()), T.StructField("report_id", T.StringType()),
])


def findings(docs: DataFrame, labels: DataFrame, settings: dict) -> DataFrame:
    """Scored findings, the first of their copies, with ``copies``."""
    found = C.drop_out_of_scope(B.candidates_of(B.hits_of(B.lines_of(docs))), settings["out_of_scope"])
    if settings["exclude_paths"]:
        found = C.drop_excluded_paths(found, settings["exclude_paths"])
    files = docs.groupBy(B.file_name().alias("file")).agg(F.min(C.fingerprint(F.col("text"))).alias("fingerprint"))
    found = C.dedup(found).withColumn("seq", F.struct("seq.*", "sink_file"))  # files of one doc_id in several sources have an order, too
    return A.scored(B.labelled(C.first_of_copies(found, files), labels))


def _rows(df: DataFrame, **columns) -> DataFrame:
    """df in the columns of the output; what is not named is null."""
    given = {"report_id": F.col("report_id")} | columns
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA])


def report(docs: DataFrame, labels: DataFrame, settings: dict) -> DataFrame:
    """All rows of the reports that are asked for."""
    asked = docs.select(F.col("source").alias("report_id")).distinct()
    found = findings(docs, labels, settings)
    if settings["sources"]:
        asked, found = (x.where(F.col("report_id").isin(settings["sources"])) for x in (asked, found))
    found = cut(found.select("report_id", "seq", "sink_file", "sink_line", "severity", "rule_id", "rule_ids", "finding", "verdict", "risk_level", "cvss_vector", "cvss_score", "copies"), "findings")
    order = [*A.report_rank(), F.col("seq"), F.col("verdict")]
    placed = ranked(found.withColumn("verdict_reachable", F.col("finding.reachable")).drop("finding"), ["report_id"], order)
    one = _rows(
        placed, kind=F.lit("finding"), place=F.col("place"), item=F.concat(X.slashes(F.col("sink_file")), F.lit(":"), "sink_line"), rules=F.array_join("rule_ids", ","), verdict=F.col("verdict"), risk_level=F.col("risk_level"),
        cvss_vector=F.concat(F.lit("CVSS:3.1/"), "cvss_vector"), cvss_score=F.format_string("%.1f", "cvss_score"), n=F.col("copies"),
    )
    hits = found.select("report_id", F.explode(X.rule_ids_of(F.col("rule_ids"), F.col("rule_id"))).alias("rule")).groupBy("report_id", "rule").agg(F.count("*").alias("n"))
    rules = _rows(ranked(hits, ["report_id"], [-F.col("n"), F.col("rule")]), kind=F.lit("rule"), place=F.col("place"), item=F.col("rule"), n=F.col("n"))
    counted = [*[F.count_if(F.col("verdict") == v).alias(f"verdict {v}") for v in A.VERDICTS], *[F.count_if(F.col("risk_level") == r).alias(f"risk {r}") for r in A.RISKS]]
    totals = asked.withColumnRenamed("report_id", "_asked").join(found.groupBy("report_id").agg(*counted), F.col("_asked").eqNullSafe(F.col("report_id")), "left").drop("report_id").withColumnRenamed("_asked", "report_id")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("place"), F.lit(x).alias("item"), F.coalesce(F.col(f"{k} {x}"), F.lit(0)).alias("n")) for k, names in (("verdict", A.VERDICTS), ("risk", A.RISKS)) for i, x in enumerate(names, 1)])
    sums = totals.select("report_id", F.inline(each))
    return one.unionByName(rules).unionByName(_rows(sums, kind=F.col("kind"), place=F.col("place"), item=F.col("item"), n=F.col("n")))


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(output)


def run(spark: SparkSession, documents: str, labels: str, output: str, settings: dict | None = None) -> dict:
    """Make the reports of all documents, or of the sources that the config names; returns what was read and written."""
    settings = DEFAULTS | (settings if settings is not None else config(beside(__file__), DEFAULTS))
    docs = spark.read.parquet(documents).select("doc_id", "text", "lang", "source")
    marks = spark.read.parquet(labels).select("doc_id", "quality", "toxic")
    out = spread(report(docs, marks, settings), BY, "item", settings["files_per_report"])
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if settings["sources"] else "static").partitionBy(*BY).parquet(output)
    new = read(spark, output)
    if settings["sources"]:
        new = new.where(F.col("report_id").isin(settings["sources"]))
    told = new.agg(F.count("*").alias("rows"), F.count_if(F.col("kind") == "finding").alias("findings"), F.count_if((F.col("kind") == "verdict") & (F.col("place") == 1)).alias("reports")).first().asDict()
    log.info("read %s and %s; wrote %d reports, %d findings, %d rows to %s", documents, labels, told["reports"], told["findings"], told["rows"], output)
    return told


if __name__ == "__main__":
    main(run, DEFAULTS, ("documents", "labels", "output"), __file__)
