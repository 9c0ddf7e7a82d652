"""Filters and merges between raw hits and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs
from ..functions import scalars as X


def normalize(raw: DataFrame, root: str = "", files: DataFrame | None = None, details: DataFrame | None = None) -> DataFrame:
    """Raw engine hits (check_id, path, start, end, extra) as candidates.

    The source is where a trace's first location says, file and line, else the sink; a trace of any other shape (no list behind the tag, no
    path or line) counts as none.  files (file, content binary, is_cpp) gives the matched bytes as code_snippet - blank where the file, the
    offsets or the bytes are not there - and drops hits of C++ rules in headers that are no C++.  details (rule_id, file, line, message,
    rule_confidence, static_analysis) overrides what the rule says."""
    trace = F.try_parse_json(F.col("extra.dataflow_trace").cast("string"))
    at = lambda what, kind: F.try_variant_get(trace, f"$.taint_source[1][0].{what}", kind)
    line, place = at("start.line", "int"), F.coalesce(at("path", "string"), F.lit(""))
    has = {f.name for f in raw.schema["extra"].dataType["metadata"].dataType.fields}
    meta = lambda name, other: F.coalesce(F.col(f"extra.metadata.{name}"), other) if name in has else other
    none = F.lit(None).cast("string")
    span = lambda side, name: F.col(f"{side}.{name}") if side in raw.columns and name in {f.name for f in raw.schema[side].dataType.fields} else F.lit(None).cast("int")
    sink = relative(F.col("path"), root)
    out = raw.select(
        F.col("check_id").alias("rule_id"),
        X.strip(F.coalesce("extra.message", F.lit(""))).alias("message"),
        F.col("extra.severity").alias("severity"),
        F.col("extra.metadata.cwe").alias("cwe"),
        meta("owasp", F.lit(None).cast("array<string>")).alias("owasp"),
        F.when(line.isNotNull(), relative(place, root)).otherwise(sink).alias("source_file"),
        F.coalesce(line, F.col("start.line")).alias("source_line"),
        sink.alias("sink_file"),
        F.col("start.line").alias("sink_line"),
        span("start", "col").alias("sink_column"),
        span("end", "line").alias("sink_end_line"),
        span("end", "col").alias("sink_end_column"),
        F.when(line.isNotNull(), relative(place, root) == sink).otherwise(True).alias("is_intraprocedural"),
        meta("verification", F.lit("dataflow")).alias("verification_mode"),
        meta("confidence", none).alias("rule_confidence"),
        meta("remediation", F.lit("")).alias("rule_remediation"),
        meta("language", F.lit("")).alias("_language"),
        span("start", "offset").alias("_from"),
        span("end", "offset").alias("_to"),
    )
    if files is not None:
        own = files.select(F.col("file").alias("sink_file"), "content", "is_cpp")
        out = out.join(own, "sink_file", "left")
        header = (F.col("_language") == "cpp") & F.lower("sink_file").endswith(".h")
        out = out.where(~header | F.coalesce("is_cpp", F.lit(False))).withColumn("code_snippet", snippet(F.col("content"), F.col("_from"), F.col("_to"))).drop("content", "is_cpp")
    else:
        out = out.withColumn("code_snippet", F.lit(""))
    out = out.drop("_language", "_from", "_to").withColumn("static_analysis", none)
    if details is not None:
        said = details.select("rule_id", F.col("file").alias("sink_file"), F.col("line").alias("sink_line"), *[F.col(c).alias(f"_{c}") for c in DETAILS])
        out = out.join(said, ["rule_id", "sink_file", "sink_line"], "left")
        for c in DETAILS:
            out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out.withColumn("dedup_key", dedup_key())


DETAILS = ("message", "rule_confidence", "static_analysis")


def relative(path: Column, root: str) -> Column:
    """A path below the root as seen from there; others as they are."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path) if root else path


def snippet(content: Column, start: Column, end: Column) -> Column:
    """The text of a file's bytes from start to end (offsets from 0); bytes that are no UTF-8 are replaced, what is not there is blank."""
    cut = F.substr(content, start + 1, F.greatest(end - start, F.lit(0)))
    return F.coalesce(F.make_valid_utf8(cut.cast("string")), F.lit(""))


def first_candidates(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first n candidates in their order."""
    return df.orderBy(seq).limit(n)


def with_candidates(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Findings of reports and candidates without verdicts in one table; columns that one side lacks are null."""
    return findings.unionByName(candidates, allowMissingColumns=True)


def dedup_key() -> Column:
    return F.sha2(F.concat_ws(":", "source_file", "source_line", "sink_file", "sink_line"), 256)


def drop_out_of_scope(df: DataFrame, deny: list[str]) -> DataFrame:
    return df.where(X.in_scope(X.cwe_ids(F.col("cwe")), deny)) if deny else df


def drop_excluded_paths(df: DataFrame, patterns: list[str], column: str = "sink_file") -> DataFrame:
    return df.where(~globs.excluded(F.col(column), patterns))


def dedup(df: DataFrame) -> DataFrame:
    """One row for each source and sink pair: the first hit's columns, all rule ids and messages in order (with repeats), and
    mode dataflow as soon as the members differ.  ``seq`` gives the order."""
    first = [c for c in df.columns if c not in ("seq", "verification_mode")]
    grouped = df.withColumn("dedup_key", dedup_key()).groupBy("dedup_key").agg(
        F.min_by(F.struct(*first), "seq").alias("first"),
        F.min("seq").alias("seq"),
        F.array_sort(F.collect_list(F.struct("seq", "rule_id", "message"))).alias("all"),
        F.min("verification_mode").alias("low"),
        F.max("verification_mode").alias("high"),
    )
    return grouped.select(
        "seq", "dedup_key", "first.*", F.transform("all", lambda x: x["rule_id"]).alias("rule_ids"), F.transform("all", lambda x: x["message"]).alias("messages"),
        F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("dataflow").alias("verification_mode"),
    )


def fingerprint(text: Column) -> Column:
    """Digest of a file's lines but for package and import lines and trailing blanks: equal for copies in other packages."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~F.regexp_replace(x, r"^\s+", "").rlike("^(package|import) "))
    return F.sha2(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n"), 256)


def _printed(df: DataFrame, files: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its source's and sink's fingerprints and its rules in order, and the columns by which copies are equal."""
    for side in ("source", "sink"):
        other = files.select(F.col("file").alias(f"{side}_file"), F.col("fingerprint").alias(f"{side}_print"))
        df = df.join(other, f"{side}_file", "left").withColumn(f"{side}_print", F.coalesce(f"{side}_print", F.concat(F.lit("path:"), F.col(f"{side}_file"))))
    return df.withColumn("rules", F.array_sort("rule_ids")), ["source_print", "source_line", "sink_print", "sink_line", "rules"]


def _merged_copies(df: DataFrame, files: DataFrame, more: Column) -> DataFrame:
    kept = [c for c in df.columns if c not in ("seq", "source_line", "sink_line")]
    df, keys = _printed(df, files)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*kept), "seq").alias("first"), F.min("seq").alias("seq"), more)


def dedup_copies(df: DataFrame, files: DataFrame) -> DataFrame:
    """Of findings at the same lines of copied files with the same rules the first, and where the others are, in order.
    files: file, fingerprint; an unknown file only equals itself."""
    grouped = _merged_copies(df, files, F.array_sort(F.collect_list(F.struct("seq", "sink_file"))).alias("all"))
    later = F.expr("transform(slice(all, 2, greatest(size(all) - 1, 0)), x -> x.sink_file)")
    return grouped.select("seq", "first.*", "rules", "source_line", "sink_line", later.alias("duplicate_locations"))


def first_of_copies(df: DataFrame, files: DataFrame) -> DataFrame:
    """As dedup_copies, but for how many there are (``copies``, itself included) instead of where: a group of any size is one small row."""
    return _merged_copies(df, files, F.count("*").alias("copies")).select("seq", "first.*", "rules", "source_line", "sink_line", "copies")
