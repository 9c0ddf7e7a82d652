"""Archive ingest: quotas, escaping paths, the common root, and sources of JSON reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut
from .ordered import ranked

# Limits of an archive.
MAX_ENTRIES, MAX_BYTES = 20_000, 500 << 20


def quota(entries: DataFrame, archive: str, order: str, size: str, max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """entries with running totals within their archive and whether they are accepted."""
    out = ranked(entries, [archive], [F.col(order)], "running_entries", {"running_bytes": size})
    return out.withColumn("accepted", (F.col("running_bytes") <= max_bytes) & (F.col("running_entries") <= max_entries))


def escapes(path: str = "path"):
    """True for absolute paths and for those that climb out of their folder."""
    depth = F.aggregate(
        F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/"),
        F.struct(F.lit(0).alias("at"), F.lit(False).alias("out")),
        lambda a, s: F.struct(
            F.when(s == "..", a["at"] - 1).when((s == "") | (s == "."), a["at"]).otherwise(a["at"] + 1).alias("at"),
            (a["out"] | ((s == "..") & (a["at"] <= 0))).alias("out"),
        ),
    )
    return F.col(path).rlike(r"^([/\\]|[A-Za-z]:)") | depth["out"]


def strip_common_root(entries: DataFrame, archive: str) -> DataFrame:
    """entries with ``stripped``: the path without the one top folder all of an archive's entries share, if there is one and it holds more than itself."""
    top = F.split("path", "/")[0]
    roots = entries.groupBy(archive).agg(F.min(top).alias("root"), (F.min(top) == F.max(top)).alias("one"), F.bool_and(F.col("path") == top).alias("alone"))
    ok = F.col("one") & ~F.col("alone") & ~F.col("root").isin("", ".", "..")
    return entries.join(roots, archive).withColumn("stripped", F.when(ok, F.expr("substring(path, length(root) + 2)")).otherwise(F.col("path"))).drop("root", "one", "alone")


def read_archives(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """archive, entry_seq, path, size, content, stripped, refused of the zip files under a path: each archive is unpacked by one task, entry by
    entry, and never beyond its limits; escaping and unnamed entries are left out.  An archive beyond the limits, or one that is no zip
    file, gives one row that says so in refused (null for entries) and has nothing else."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                said, columns = None, ["archive", "entry_seq", "path", "size", "content", "refused"]
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = [i for i in z.infolist() if i.filename and not i.is_dir()]
                        if len(infos) > max_entries:
                            said = f"{len(infos)} entries, {max_entries} are allowed"
                        elif (size := sum(i.file_size for i in infos)) > max_bytes:
                            said = f"{size} bytes, {max_bytes} are allowed"
                        for seq, info in enumerate([] if said else infos):
                            with z.open(info) as f:
                                yield pd.DataFrame([(name, seq, info.filename, info.file_size, f.read(info.file_size + 1)[: info.file_size], None)], columns=columns)
                except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError) as e:
                    said = f"not readable: {e}"
                if said:
                    yield pd.DataFrame([(name, None, None, None, None, said)], columns=columns)

    # unpacked once, for the entries and for what was refused
    out = cut(files.mapInPandas(run, "archive string, entry_seq int, path string, size long, content binary, refused string"), "archives")
    read = strip_common_root(out.where("refused IS NULL").where(~escapes()), "archive")
    return read.unionByName(out.where("refused IS NOT NULL"), allowMissingColumns=True)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Findings of JSON report files with the file's name as report_id; unreadable files give nothing."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("report_id"), "value")
    return raw.select("report_id", F.explode(F.from_json("value", f"findings array<struct<{schema}>>")["findings"]).alias("f")).select("report_id", "f.*")


def read_candidates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Candidates of JSON files (an array in each); files that are missing, unreadable or no array give nothing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
        return spark.createDataFrame([], schema)
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("c")).where("c IS NOT NULL").select("c.*")


def write_report(findings: DataFrame, summary: DataFrame, path: str, project: str) -> None:
    """report.json parts: one JSON object a finding, and the summary with the project's name beside it."""
    findings.write.mode("overwrite").json(f"{path}/findings")
    summary.select(F.lit(project).alias("project"), F.struct("*").alias("summary")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
