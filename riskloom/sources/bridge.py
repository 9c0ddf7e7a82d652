"""The driver's tables seen as the finding dataflow's inputs (lines, hits, candidates, findings, graphs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules over text lines: id, severity, weakness strings, verification mode, confidence, regular expression.
RULES = [
    ("email", "WARNING", ["CWE-200: Exposure of Sensitive Information ('Information Exposure')"], "dataflow", "MEDIUM", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"),
    ("ipv4", "WARNING", ["CWE-200: Exposure of Sensitive Information ('Information Exposure')", "CWE-918: Server-Side Request Forgery (SSRF)"], "dataflow", "LOW", r"[0-9]{1,3}(\.[0-9]{1,3}){3}"),
    ("license", "INFO", [], "dataflow", "LOW", r"(?i)(licen[sc]e|copyright|SPDX)"),
    ("long-digits", "WARNING", ["CWE-359: Exposure of Private Personal Information"], "dataflow", "LOW", r"\+?[0-9][0-9 -]{8,}[0-9]"),
    ("pipe-row", "WARNING", ["CWE-327: Use of a Broken or Risky Cryptographic Algorithm"], "dataflow", "LOW", r" \| "),
    ("secret-token", "ERROR", ["CWE-798: Use of Hard-coded Credentials ('Hard-coded Credentials')"], "static", "HIGH", r'token = "[0-9a-f]{40}"'),
]
#: Text that a rule's expression can't match without: lines that lack it are told by a plain search, which is cheaper by far.
NEEDED = {"email": "@", "pipe-row": " | ", "secret-token": 'token = "'}
# Weakness classes that are out of scope.
OUT_OF_SCOPE = ["CWE-295", "CWE-297", "CWE-311", "CWE-319", "CWE-326", "CWE-327", "CWE-328", "CWE-329", "CWE-330", "CWE-338", "CWE-347", "CWE-352", "CWE-614", "CWE-1004", "CWE-1275"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_name() -> Column:
    """The path a document stands for; what is null is blank in it."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(part("source"), F.lit("/"), part("lang"), F.lit("/d"), part("doc_id"), F.lit(".txt"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, file, line_no (from 1), line of a documents table, static or streaming."""
    docs = docs.select("doc_id", "source", "lang", file_name().alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return docs.select("doc_id", "source", "lang", "file", (F.col("pos") + 1).alias("line_no"), "line")


def src_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents"))


def hits_of(lines: DataFrame) -> DataFrame:
    """One row for each rule that a line matches; all rules are tried in one pass over the lines, without a join."""
    struct = lambda r: F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("severity"), F.array(*[F.lit(c) for c in r[2]]).cast("array<string>").alias("cwe"), F.lit(r[3]).alias("mode"), F.lit(r[4]).alias("confidence"))
    fits = lambda r: F.col("line").contains(NEEDED[r[0]]) & F.col("line").rlike(r[5]) if r[0] in NEEDED else F.col("line").rlike(r[5])
    found = F.array(*[F.when(fits(r), struct(r)) for r in RULES])
    return lines.select("*", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("hit")).select("doc_id", "source", "lang", "file", "line_no", "line", "hit.*")


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(src_lines(spark, sf_dir))


def candidates_of(hits: DataFrame) -> DataFrame:
    """Normalised hits; ``seq`` orders them as they were found."""
    return hits.select(
        F.struct("doc_id", "line_no", "rule_id").alias("seq"),
        "doc_id",
        "rule_id",
        F.concat(F.lit("matched "), "rule_id").alias("message"),
        "severity",
        "cwe",
        F.col("file").alias("source_file"),
        F.col("line_no").alias("source_line"),
        F.col("file").alias("sink_file"),
        F.col("line_no").alias("sink_line"),
        F.col("mode").alias("verification_mode"),
        "confidence",
        F.col("source").alias("report_id"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates_of(raw_hits(spark, sf_dir))


def labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    """df with the finding of its doc_id's label; no label: null, which stands for unverified."""
    reachable = F.when(F.col("toxic") == 1, "yes").when(F.col("quality") == 0, "uncertain").otherwise("no")
    reasoning = F.when(F.col("doc_id") % 17 == 0, "verifier_failed: no reply").otherwise("label")
    found = labels.select("doc_id", F.struct(reachable.alias("reachable"), reasoning.alias("reasoning")).alias("finding"))
    return df.join(found, "doc_id", "left")


def with_finding(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(df, table(spark, sf_dir, "labels"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, callee: customer -> order -> lineitem -> part, supplier -> lineitem, nation -> customer and supplier."""
    t = lambda n: table(spark, sf_dir, n)
    tag = lambda kind, *c: F.concat_ws(":", F.lit(kind), *[F.col(x).cast("string") for x in c])
    orders, items = t("orders"), t("lineitem")
    line = tag("l", "l_orderkey", "l_linenumber")
    parts = [
        orders.select(tag("c", "o_custkey").alias("caller"), tag("o", "o_orderkey").alias("callee")),
        items.select(tag("o", "l_orderkey"), line),
        items.select(line, tag("p", "l_partkey")),
        items.select(tag("s", "l_suppkey"), line),
        t("customer").select(tag("n", "c_nationkey"), tag("c", "c_custkey")),
        t("supplier").select(tag("n", "s_nationkey"), tag("s", "s_suppkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    node = F.concat_ws("#", F.col("user_id").cast("string"), "event_type", F.hour("ts").cast("string"))
    return events.select("user_id", "event_type", "ts", "event_id", node.alias("node"))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, callee: consecutive events of one user."""
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return event_nodes(spark, sf_dir).select(F.col("node").alias("caller"), F.lead("node").over(by).alias("callee")).where("callee IS NOT NULL").distinct()


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text: a class in Java or Python for each part, with a method that may be an entry, a helper that it calls on itself, calls of
    other classes' methods - in Java on a variable of such a class, which is imported by name, with its package, or not at all - and a sink."""
    p = F.col("p_partkey")
    name = lambda kind, n: F.concat(F.lit(kind), n.cast("string"))
    m, n, other = name("m", p % 97), name("n", p % 89), name("m", p * 7 % 97)
    entry, t, up = p % 5 == 0, p * 7 % 97, F.floor(p / 2)
    package = lambda x: F.concat(F.lit("b"), F.floor(x / 2) % 2)
    java = [
        F.concat(F.lit("package "), package(p), F.lit(";")),
        F.concat(F.lit("import "), package(up), F.lit("."), name("C", up), F.lit(";")),
        F.when(p % 3 == 0, F.lit("import b0.*; \nimport b1.*;")).when(p % 3 == 1, F.concat(F.lit("import "), package(t), F.lit("."), name("C", t), F.lit(";\n"))).otherwise("\n"),
        F.concat(F.lit("public class "), name("C", p), F.lit(" extends "), name("C", up), F.lit(" {")),
        F.when(entry, F.concat(F.lit('  @GetMapping("/x'), p, F.lit('")'))).otherwise("  // inner"),
        F.concat(F.lit("  public String "), m, F.lit("(String a, int b) {")),
        F.concat(F.lit("    return this."), n, F.lit("(a);")),
        F.lit("  }"),
        F.concat(F.lit("  String "), n, F.lit("(String a) {")),
        F.concat(F.lit("    final "), name("C", t), F.lit(" c = null; c."), other, F.lit("(a, 1);")),
        F.lit("    return p.parseExpression(a);"),
        F.lit("  }"),
        F.lit("}"),
    ]
    python = [
        F.concat(F.lit("class "), name("P", p), F.lit(":")),
        F.when(entry, F.concat(F.lit('    @app.route("/y'), p, F.lit('")'))).otherwise("    # inner"),
        F.concat(F.lit("    def "), m, F.lit("(self, a, b):")),
        F.concat(F.lit("        return self."), n, F.lit("(a)")),
        F.concat(F.lit("    def "), n, F.lit("(self, a):")),
        F.concat(F.lit("        other."), other, F.lit("(a, 1)")),
        F.lit('        return db.execute("select " + a)'),
    ]
    text = F.when(p % 2 == 0, F.concat_ws("\n", *java)).otherwise(F.concat_ws("\n", *python))
    path = F.when(p % 2 == 0, F.concat(F.lit("shop/C"), p, F.lit(".java"))).otherwise(F.concat(F.lit("web/p"), p, F.lit(".py")))
    # a small table makes many texts, and reading them is work for all tasks
    parts = table(spark, sf_dir, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(path.alias("path"), text.alias("text"))
