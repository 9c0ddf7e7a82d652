"""Registered queries of the finding dataflow, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cvss, globs
from ..functions import scalars as X
from ..functions.storage import cut
from ..operators import analytics as A
from ..operators import candidates as C
from ..operators.ordered import ranked
from ..sources import bridge as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]::VARCHAR[]"


# --- shared SQL, as common table expressions -------------------------------------------------------------------

_RULES = ", ".join(f"('{r}', '{s}', {_quoted(c)}, '{m}', '{k}', '{x}')" for r, s, c, m, k, x in B.RULES)
LINES = """src AS (SELECT doc_id, source, lang, source || '/' || lang || '/d' || doc_id || '.txt' AS file, string_split(text, chr(10)) AS ls FROM documents),
src_lines AS (SELECT doc_id, source, lang, file, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM src)"""
HITS = f"""{LINES},
rules(rule_id, severity, cwe, mode, confidence, regex) AS (VALUES {_RULES}),
raw_hits AS (SELECT l.*, r.* FROM src_lines l JOIN rules r ON regexp_matches(l.line, r.regex))"""
CANDIDATES = f"""{HITS},
cand AS (SELECT doc_id, line_no, rule_id, 'matched ' || rule_id AS message, severity, cwe, file AS sink_file, line_no AS sink_line, mode, confidence, source AS report_id,
         sha256(file || ':' || line_no || ':' || file || ':' || line_no) AS dedup_key,
         list_distinct(list_transform(cwe, lambda c: upper(trim(string_split(c, ':')[1])))) AS ids FROM raw_hits)"""
SCOPED = f"{CANDIDATES},\nscoped AS (SELECT * FROM cand WHERE len(ids) = 0 OR len(list_filter(ids, lambda i: NOT list_contains({_quoted(B.OUT_OF_SCOPE)}, i))) > 0)"
MERGED = f"""{SCOPED},
merged AS (SELECT dedup_key, min(doc_id) AS doc_id, min(line_no) AS line_no, arg_min(rule_id, rule_id) AS rule_id, arg_min(severity, rule_id) AS severity, arg_min(cwe, rule_id) AS cwe, arg_min(ids, rule_id) AS ids,
           arg_min(confidence, rule_id) AS confidence, any_value(sink_file) AS sink_file, any_value(sink_line) AS sink_line, any_value(report_id) AS report_id, list(rule_id ORDER BY rule_id) AS rule_ids,
           list(message ORDER BY rule_id) AS messages, CASE WHEN count(DISTINCT mode) > 1 THEN 'dataflow' ELSE min(mode) END AS mode FROM scoped GROUP BY dedup_key)"""
FINDINGS = f"""{MERGED},
lab AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'yes' WHEN quality = 0 THEN 'uncertain' ELSE 'no' END AS reachable, doc_id % 17 = 0 AS failed FROM labels),
finding AS (SELECT m.*, CASE WHEN l.reachable IS NULL THEN 'unverified' WHEN l.failed THEN 'failed' ELSE l.reachable END AS verdict, l.reachable FROM merged m LEFT JOIN lab l ON m.doc_id = l.doc_id)"""
PER_RULE = f"{FINDINGS},\nper_rule AS (SELECT report_id, sink_file, verdict, len(rule_ids) = 1 AS solo, unnest(rule_ids) AS rule FROM finding)"
_VERDICT_COUNTS = "count(*) AS hits, count(*) FILTER (WHERE solo) AS solo_hits, " + ", ".join(f'count(*) FILTER (WHERE verdict = \'{v}\') AS "{v}"' for v in A.VERDICTS)
STATS = f"{PER_RULE},\nstats AS (SELECT rule, {_VERDICT_COUNTS}, count(DISTINCT report_id) AS reports FROM per_rule GROUP BY rule)"
CLUSTERS = f"{STATS},\nclusters AS (SELECT rule, sink_file AS file, {_VERDICT_COUNTS} FROM per_rule WHERE sink_file <> '' GROUP BY rule, sink_file)"
_VECTORS = ", ".join(f"('{c}', '{v}')" for c, v in cvss.CWE_VECTORS.items())
# The score again, by joined weight tables (the published metric values) instead of the library's formula.
BANDS = "bands(name, low) AS (VALUES ('critical', 9.0), ('high', 7.0), ('medium', 4.0), ('low', 0.1))"
VECTORS = f"""vec(cwe, vector) AS (VALUES {_VECTORS}), dflt(vector) AS (VALUES ('{cvss.DEFAULT_VECTOR}')), {BANDS},
wt(metric, letter, same, changed) AS (VALUES ('AV', 'N', 0.85, 0.85), ('AV', 'A', 0.62, 0.62), ('AV', 'L', 0.55, 0.55), ('AV', 'P', 0.2, 0.2), ('AC', 'L', 0.77, 0.77), ('AC', 'H', 0.44, 0.44), ('PR', 'N', 0.85, 0.85), ('PR', 'L', 0.62, 0.68),
  ('PR', 'H', 0.27, 0.5), ('UI', 'N', 0.85, 0.85), ('UI', 'R', 0.62, 0.62), ('C', 'H', 0.56, 0.56), ('C', 'L', 0.22, 0.22), ('C', 'N', 0, 0), ('I', 'H', 0.56, 0.56), ('I', 'L', 0.22, 0.22), ('I', 'N', 0, 0), ('A', 'H', 0.56, 0.56), ('A', 'L', 0.22, 0.22), ('A', 'N', 0, 0)),
metrics AS (SELECT vector, split_part(x, ':', 1) AS metric, split_part(x, ':', 2) AS letter FROM (SELECT vector, unnest(string_split(vector, '/')) AS x FROM (SELECT vector FROM vec UNION SELECT vector FROM dflt))),
scope AS (SELECT vector, bool_or(metric = 'S' AND letter = 'C') AS wide FROM metrics GROUP BY vector),
weighed AS (SELECT x.vector, s.wide, x.metric, CAST(CASE WHEN s.wide THEN w.changed ELSE w.same END AS DOUBLE) AS w FROM metrics x JOIN scope s ON s.vector = x.vector JOIN wt w ON w.metric = x.metric AND w.letter = x.letter),
lost AS (SELECT vector, wide, 8.22 * product(w) FILTER (WHERE metric IN ('AV', 'AC', 'PR', 'UI')) AS ease, 1 - product(1 - w) FILTER (WHERE metric IN ('C', 'I', 'A')) AS iss FROM weighed GROUP BY vector, wide),
felt AS (SELECT vector, wide, ease, CASE WHEN wide THEN 7.52 * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15) ELSE 6.42 * iss END AS impact FROM lost),
cv AS (SELECT vector, CASE WHEN impact <= 0 THEN 0 ELSE ceil(round(least((impact + ease) * CASE WHEN wide THEN 1.08 ELSE 1 END, 10) * 10, 4)) / 10 END AS score FROM felt),
vecs AS (SELECT v.cwe, v.vector, cv.score FROM vec v JOIN cv ON cv.vector = v.vector)"""


def _band(score: str) -> str:
    return f"coalesce((SELECT arg_max(b.name, b.low) FROM bands b WHERE b.low <= {score}), 'none')"


SCORED = f"""{FINDINGS},
{VECTORS},
best AS (SELECT f.dedup_key, arg_max(v.vector, (v.score, v.vector)) AS vector, max(v.score) AS score FROM (SELECT dedup_key, unnest(ids) AS id FROM finding) f JOIN vecs v ON v.cwe = f.id GROUP BY f.dedup_key),
with_score AS (SELECT f.*, coalesce(b.vector, d.vector) AS cvss_vector, coalesce(b.score, d.score) AS cvss_score FROM finding f LEFT JOIN best b ON b.dedup_key = f.dedup_key, (SELECT cv.* FROM dflt JOIN cv ON cv.vector = dflt.vector) d),
banded AS (SELECT *, {_band("cvss_score")} AS band FROM with_score),
scored AS (SELECT *, CASE WHEN verdict = 'no' THEN 'low' WHEN verdict = 'yes' THEN band WHEN band = 'critical' THEN 'high' WHEN band = 'high' THEN 'medium' ELSE 'low' END AS risk_level,
           CASE WHEN len(cwe) = 0 THEN 'Uncategorized' WHEN regexp_extract(cwe[1], '\\(''([^'']+)''\\)\\s*$', 1) <> '' THEN regexp_extract(cwe[1], '\\(''([^'']+)''\\)\\s*$', 1) ELSE cwe[1] END AS vuln_type FROM banded)"""


# --- shared DataFrames -----------------------------------------------------------------------------------------


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup(C.drop_out_of_scope(B.candidates(spark, sf_dir), B.OUT_OF_SCOPE))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_finding(merged(spark, sf_dir), spark, sf_dir)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scored(findings(spark, sf_dir)).withColumn("vuln_type", X.vuln_type(F.col("cwe")))


def _joined(c: str):
    return F.array_join(c, ",")


# --- rule matching, filters, merges ----------------------------------------------------------------------------


@query(f"WITH {HITS} SELECT rule_id, count(*) AS hits, count(DISTINCT file) AS files, CAST(sum(line_no) AS BIGINT) AS line_sum FROM raw_hits GROUP BY rule_id")
def regex_rule_hits(spark, sf_dir):
    return B.raw_hits(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("hits"), F.count_distinct("file").alias("files"), F.sum("line_no").alias("line_sum"))


@query(f"WITH {HITS} SELECT rule_id, count(*) AS hits FROM raw_hits WHERE regexp_matches(file, '(^|/)en/d[^/]*5\\.txt(/|$)') GROUP BY rule_id")
def rule_path_include(spark, sf_dir):
    keep = globs.excluded(F.col("file"), ["**/en/d*5.txt"])
    return B.raw_hits(spark, sf_dir).where(keep).groupBy("rule_id").agg(F.count("*").alias("hits"))


@query(f"WITH {SCOPED} SELECT rule_id, array_to_string(list_sort(ids), ',') AS ids, count(*) AS hits FROM scoped GROUP BY rule_id, list_sort(ids)")
def scope_filter(spark, sf_dir):
    df = C.drop_out_of_scope(B.candidates(spark, sf_dir), B.OUT_OF_SCOPE)
    return df.groupBy("rule_id", F.array_join(F.array_sort(X.cwe_ids(F.col("cwe"))), ",").alias("ids")).agg(F.count("*").alias("hits"))


EXCLUDED = ["src1?", "**/de/**", "*1.txt", "spam-farm.*"]


@query(r"""SELECT 'page' AS kind, page_id AS id FROM pages WHERE NOT regexp_matches(replace(url, '\', '/'), '(^|/)(src1[^/]|de|[^/]*1\.txt|spam\-farm\.[^/]*)(/|$)')
UNION ALL SELECT 'document', doc_id FROM documents WHERE NOT regexp_matches(source || '/' || lang || '/d' || doc_id || '.txt', '(^|/)(src1[^/]|de|[^/]*1\.txt|spam\-farm\.[^/]*)(/|$)')""")
def path_exclude(spark, sf_dir):
    pages = C.drop_excluded_paths(B.table(spark, sf_dir, "pages"), EXCLUDED, "url").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"))
    docs = B.table(spark, sf_dir, "documents").withColumn("file", B.file_name())
    return pages.unionAll(C.drop_excluded_paths(docs, EXCLUDED, "file").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id")))


@query("""SELECT page_id, CASE WHEN len(p) <= 2 THEN array_to_string(p, '/') ELSE '.../' || p[-2] || '/' || p[-1] END AS short, string_split(url, '/')[-1] AS base
FROM (SELECT page_id, url, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages)""")
def short_location(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select("page_id", X.short_location(F.col("url")).alias("short"), X.basename(F.col("url")).alias("base"))


@query(f"WITH {CANDIDATES} SELECT doc_id, line_no, rule_id, dedup_key FROM cand")
def dedup_key(spark, sf_dir):
    return B.candidates(spark, sf_dir).select("doc_id", F.col("sink_line").alias("line_no"), "rule_id", C.dedup_key().alias("dedup_key"))


@query(f"WITH {MERGED} SELECT dedup_key, doc_id, sink_line, rule_id, severity, array_to_string(rule_ids, ',') AS rule_ids, array_to_string(messages, ',') AS messages, mode FROM merged")
def dedup_candidates(spark, sf_dir):
    return merged(spark, sf_dir).select("dedup_key", "doc_id", "sink_line", "rule_id", "severity", _joined("rule_ids").alias("rule_ids"), _joined("messages").alias("messages"), F.col("verification_mode").alias("mode"))


_PRINT = r"sha256(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(package|import) ')), lambda x: regexp_replace(x, '\s+$', '')), chr(10)))"


@query(f"SELECT doc_id, {_PRINT} AS fingerprint FROM documents")
def copy_fingerprint(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", C.fingerprint(F.col("text")).alias("fingerprint"))


@query(f"""WITH {MERGED},
prints AS (SELECT source || '/' || lang || '/d' || doc_id || '.txt' AS file, {_PRINT} AS fp FROM documents),
g AS (SELECT p.fp, m.sink_line, list_sort(m.rule_ids) AS rules, m.doc_id, m.sink_file, row_number() OVER (PARTITION BY p.fp, m.sink_line, list_sort(m.rule_ids) ORDER BY m.doc_id, m.sink_line, m.rule_id) AS n
      FROM merged m JOIN prints p ON p.file = m.sink_file)
SELECT min(doc_id) FILTER (WHERE n = 1) AS doc_id, sink_line, array_to_string(rules, ',') AS rules, coalesce(string_agg(sink_file, ',' ORDER BY n) FILTER (WHERE n > 1), '') AS duplicates FROM g GROUP BY fp, sink_line, rules""")
def dedup_copies(spark, sf_dir):
    files = B.table(spark, sf_dir, "documents").select(B.file_name().alias("file"), C.fingerprint(F.col("text")).alias("fingerprint"))
    df = C.dedup_copies(merged(spark, sf_dir), files)
    return df.select("doc_id", "sink_line", F.array_join(F.array_sort("rule_ids"), ",").alias("rules"), _joined("duplicate_locations").alias("duplicates"))


# --- statistics ------------------------------------------------------------------------------------------------


@query(f"WITH {STATS} SELECT * FROM stats ORDER BY hits DESC, rule")
def rule_stats(spark, sf_dir):
    return A.rule_stats(findings(spark, sf_dir)).orderBy(F.desc("hits"), "rule")


@query(f"WITH {STATS} SELECT * FROM stats WHERE yes = 0 AND solo_hits > 0 AND no > 0")
def rule_noise(spark, sf_dir):
    return A.noisy_rules(findings(spark, sf_dir))


@query(f"WITH {CLUSTERS} SELECT * FROM clusters")
def file_clusters(spark, sf_dir):
    return A.file_clusters(findings(spark, sf_dir))


@query(f"WITH {CLUSTERS} SELECT c.*, CASE WHEN s.yes > 0 THEN 'this file' ELSE 'whole rule' END AS scope FROM clusters c JOIN stats s ON s.rule = c.rule WHERE c.yes = 0 AND c.no > 0")
def noise_clusters(spark, sf_dir):
    return A.noise_clusters(cut(findings(spark, sf_dir), "findings"))


@query(f"""WITH {FINDINGS} SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'yes') AS reachable, count(*) FILTER (WHERE verdict = 'uncertain') AS uncertain,
count(*) FILTER (WHERE verdict = 'no') AS not_reachable, count(*) FILTER (WHERE verdict = 'failed') AS verifier_failed, count(*) FILTER (WHERE verdict = 'unverified') AS unverified FROM finding""")
def verdict_summary(spark, sf_dir):
    return A.summary(findings(spark, sf_dir))


_FACET = "SELECT value, n, rank <= 5 AS shown, rank <= 8 AS expanded FROM (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM (SELECT {} AS value, count(*) AS n FROM scored GROUP BY 1))"


@query(f"WITH {SCORED} {_FACET.format('vuln_type')}")
def facet_type(spark, sf_dir):
    return A.facet(scored(spark, sf_dir), F.col("vuln_type"))


@query(f"WITH {SCORED} {_FACET.format('sink_file')}")
def facet_file(spark, sf_dir):
    return A.facet(scored(spark, sf_dir), F.col("sink_file"))


@query(f"WITH {SCORED}, o(risk_level, place) AS (VALUES ('critical', 1), ('high', 2), ('medium', 3), ('low', 4)) SELECT o.risk_level, count(*) AS n, o.place FROM scored s JOIN o ON o.risk_level = s.risk_level GROUP BY o.risk_level, o.place")
def facet_risk(spark, sf_dir):
    return A.risk_facet(scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT vuln_type, risk_level, count(*) AS n FROM scored GROUP BY CUBE (vuln_type, risk_level)")
def facet_cube(spark, sf_dir):
    return scored(spark, sf_dir).cube("vuln_type", "risk_level").agg(F.count("*").alias("n"))


@query(f"WITH {VECTORS} SELECT cwe, vector, printf('%.1f', score) AS score, {_band('score')} AS band FROM vecs")
def cvss_table(spark, sf_dir):
    return cvss.vectors(spark).select("cwe", "vector", F.format_string("%.1f", "score").alias("score"), cvss.band("score").alias("band"))


@query(f"WITH {SCORED} SELECT dedup_key, verdict, 'CVSS:3.1/' || cvss_vector AS cvss_vector, printf('%.1f', cvss_score) AS cvss_score, risk_level, vuln_type FROM scored")
def scored_findings(spark, sf_dir):
    return scored(spark, sf_dir).select("dedup_key", "verdict", F.concat(F.lit("CVSS:3.1/"), "cvss_vector").alias("cvss_vector"), F.format_string("%.1f", "cvss_score").alias("cvss_score"), "risk_level", "vuln_type")


@query(f"""WITH {FINDINGS} SELECT dedup_key, row_number() OVER (PARTITION BY report_id ORDER BY CASE reachable WHEN 'yes' THEN 0 WHEN 'no' THEN 2 ELSE 1 END, CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'INFO' THEN 2 ELSE 3 END, doc_id, sink_line, rule_id) AS place FROM finding""")
def report_order(spark, sf_dir):
    df = findings(spark, sf_dir).withColumn("verdict_reachable", F.col("finding.reachable"))
    return ranked(df.select("dedup_key", "report_id", "verdict_reachable", "severity", "seq"), ["report_id"], [*A.report_rank(), F.col("seq")]).select("dedup_key", "place")


@query(rf"""WITH {SCORED} SELECT report_id, risk_level, row_number() OVER (PARTITION BY report_id, risk_level ORDER BY sink_file, sink_line) AS n,
row_number() OVER (PARTITION BY report_id, risk_level ORDER BY sink_file, sink_line) || '. ' || vuln_type || ' `' || sink_file || ':' || sink_line || '`' AS row FROM scored""")
def markdown_rows(spark, sf_dir):
    df = scored(spark, sf_dir).select("report_id", "risk_level", "vuln_type", "sink_file", "sink_line")
    df = ranked(df, ["report_id", "risk_level"], [F.col("sink_file"), F.col("sink_line")], "n")
    place = F.concat(F.lit(" `"), X.slashes(F.col("sink_file")), F.lit(":"), "sink_line", F.lit("`"))
    return df.select("report_id", "risk_level", "n", F.concat(F.col("n"), F.lit(". "), X.one_line(F.col("vuln_type")), place).alias("row"))


_LABELS = f"""{FINDINGS},
lab2 AS (SELECT c.doc_id * 1000000 + c.line_no * 100 + length(c.rule_id) AS label_id, c.sink_file AS file, c.sink_line + c.doc_id % 4 - CASE WHEN c.doc_id % 8 > 3 THEN 2 * (c.doc_id % 4) ELSE 0 END AS line, l.reachable AS expected
         FROM scoped c JOIN lab l ON l.doc_id = c.doc_id),
hit AS (SELECT b.label_id, f.verdict, row_number() OVER (PARTITION BY b.label_id ORDER BY f.doc_id, f.sink_line, f.rule_id) AS n
        FROM lab2 b JOIN finding f ON string_split(f.sink_file, '/')[-1] = string_split(b.file, '/')[-1] AND abs(f.sink_line - b.line) <= 2),
matched AS (SELECT b.label_id, b.line, b.expected, h.verdict FROM lab2 b LEFT JOIN hit h ON h.label_id = b.label_id AND h.n = 1)"""


def _judged(spark, sf_dir):
    """Findings with their verdict, and labels made of the same candidates, which are found once."""
    scoped = cut(C.drop_out_of_scope(B.candidates(spark, sf_dir), B.OUT_OF_SCOPE), "candidates")
    return B.with_finding(C.dedup(scoped), spark, sf_dir).withColumn("verdict", X.verdict()), _labels(B.with_finding(scoped, spark, sf_dir).where("finding IS NOT NULL"))


def _labels(df):
    shift = F.col("doc_id") % 4 - F.when(F.col("doc_id") % 8 > 3, 2 * (F.col("doc_id") % 4)).otherwise(0)
    return df.select((F.col("doc_id") * 1000000 + F.col("sink_line") * 100 + F.length("rule_id")).alias("label_id"), F.col("sink_file").alias("file"), (F.col("sink_line") + shift).alias("line"), F.col("finding.reachable").alias("expected"))


@query(f"WITH {_LABELS} SELECT label_id, line, expected, verdict FROM matched")
def eval_match(spark, sf_dir):
    return A.match_labels(*_judged(spark, sf_dir)).select("label_id", "line", "expected", "verdict")


@query(f"WITH {_LABELS} SELECT count(*) AS total, count(verdict) AS matched, count(*) FILTER (WHERE verdict = expected) AS agree, printf('%.1f', CASE WHEN count(verdict) > 0 THEN round(100.0 * count(*) FILTER (WHERE verdict = expected) / count(verdict), 1) ELSE 0 END) AS pct FROM matched")
def eval_agreement(spark, sf_dir):
    return A.agreement(A.match_labels(*_judged(spark, sf_dir))).withColumn("pct", F.format_string("%.1f", "pct"))
