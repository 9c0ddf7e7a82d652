"""Aggregations over findings: rule statistics, noise, clusters, facets, summaries, agreement with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cvss
from ..functions import scalars as X

VERDICTS = ["yes", "no", "uncertain", "failed", "unverified"]
RISKS = ["critical", "high", "medium", "low"]


def _counts() -> list[Column]:
    return [F.count("*").alias("hits"), F.count_if(F.col("solo")).alias("solo_hits"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]]


def per_rule(findings: DataFrame) -> DataFrame:
    """A row for each finding and rule of it (repeats count), with its verdict and whether the rule stands alone."""
    ids = X.rule_ids_of(F.col("rule_ids"), F.col("rule_id"))
    return findings.select("report_id", "sink_file", "cwe", X.verdict().alias("verdict"), (F.size(ids) == 1).alias("solo"), F.explode(ids).alias("rule"))


def rule_stats(findings: DataFrame) -> DataFrame:
    return per_rule(findings).groupBy("rule").agg(*_counts(), F.count_distinct("report_id").alias("reports"))


def noisy_rules(findings: DataFrame) -> DataFrame:
    """Rules that never led to a reachable finding, were refuted, and found something of their own."""
    return rule_stats(findings).where("yes = 0 AND solo_hits > 0 AND no > 0")


def file_clusters(findings: DataFrame) -> DataFrame:
    each = per_rule(findings).withColumn("file", X.slashes(F.col("sink_file"))).where("file <> ''")
    return each.groupBy("rule", "file").agg(*_counts())


def noise_clusters(findings: DataFrame) -> DataFrame:
    """Files where a rule was only ever refuted; scope says whether the rule is reachable elsewhere or whether it is noise everywhere."""
    clusters = file_clusters(findings).where("yes = 0 AND no > 0")
    useful = rule_stats(findings).where("yes > 0").select("rule", F.lit(True).alias("useful"))
    return clusters.join(useful, "rule", "left").withColumn("scope", F.when(F.col("useful"), "this file").otherwise("whole rule")).drop("useful")


def summary(findings: DataFrame) -> DataFrame:
    names = {"yes": "reachable", "uncertain": "uncertain", "no": "not_reachable", "failed": "verifier_failed", "unverified": "unverified"}
    return findings.select(X.verdict().alias("v")).agg(F.count("*").alias("total"), *[F.count_if(F.col("v") == v).alias(n) for v, n in names.items()])


def scored(findings: DataFrame) -> DataFrame:
    """Findings with verdict, weakness vector, score, band and risk level."""
    df = cvss.with_vector(findings.withColumn("cwe_ids", X.cwe_ids(F.col("cwe"))))
    df = df.withColumn("verdict", X.verdict()).withColumn("band", cvss.band("cvss_score"))
    return df.withColumn("risk_level", X.risk_level(F.col("verdict"), F.col("band")))


def facet(df: DataFrame, key: Column, page: int = 5, more: int = 8) -> DataFrame:
    """Counts of a key, and whether a value is on the first page, or on it once it is expanded: the most frequent ones, equal counts by value
    (a top-n of each partition's own, then of those)."""
    counts = df.groupBy(key.alias("value")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), F.asc("value")).limit(more).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("value"))))  # so many rows
    out = counts.join(F.broadcast(first.select("value", "place")), "value", "left")
    return out.select("value", "n", F.coalesce(F.col("place") <= page, F.lit(False)).alias("shown"), F.col("place").isNotNull().alias("expanded"))


def risk_facet(df: DataFrame) -> DataFrame:
    """Risk levels that occur, in fixed order."""
    place = F.array_position(F.array(*[F.lit(r) for r in RISKS]), F.col("risk_level"))
    return df.groupBy("risk_level").agg(F.count("*").alias("n")).select("risk_level", "n", place.cast("int").alias("place")).where("place > 0")


def report_rank() -> list[Column]:
    """Sort keys of a report: reachable first, then severity."""
    return [F.when(F.col("verdict_reachable") == "yes", 0).when(F.col("verdict_reachable") == "no", 2).otherwise(1), F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARNING", 1).when(F.col("severity") == "INFO", 2).otherwise(3)]


def match_labels(findings: DataFrame, labels: DataFrame, tolerance: int = 2) -> DataFrame:
    """Each label (label_id, file, line, expected) with the first finding of its file's base name within the tolerance: a band
    join on buckets of tolerance + 1 lines, so that no file's findings meet all its labels."""
    width = tolerance + 1
    f = findings.select("seq", X.basename(F.col("sink_file")).alias("base"), F.col("sink_line").alias("at"), "verdict", (F.floor(F.col("sink_line") / width)).alias("bucket"))
    l_ = labels.select("label_id", X.basename(F.col("file")).alias("base"), "line", "expected", F.explode(F.sequence(F.floor(F.col("line") / width) - 1, F.floor(F.col("line") / width) + 1)).alias("bucket"))
    met = l_.join(f, ["base", "bucket"]).where(F.abs(F.col("line") - F.col("at")) <= tolerance)
    best = met.groupBy("label_id").agg(F.min_by("verdict", "seq").alias("verdict"), F.min_by("at", "seq").alias("at"))
    return labels.select("label_id", "file", "line", "expected").join(best, "label_id", "left")


def agreement(matched: DataFrame) -> DataFrame:
    total, found = F.count("*"), F.count("verdict")
    agree = F.count_if(F.col("verdict") == F.col("expected"))
    share = F.when(found > 0, F.round(100.0 * agree / found, 1)).otherwise(0.0)
    return matched.agg(total.alias("total"), found.alias("matched"), agree.alias("agree"), share.alias("pct"))
