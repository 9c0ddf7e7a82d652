"""CVSS v3.1 base scores by weakness class, as Column expressions and as SQL text for other engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Metric weights and bands of the CVSS v3.1 specification (sections 7.4 and 5).
AV = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
AC = {"L": 0.77, "H": 0.44}
PR_UNCHANGED = {"N": 0.85, "L": 0.62, "H": 0.27}
PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.50}
UI = {"N": 0.85, "R": 0.62}
IMPACT = {"H": 0.56, "L": 0.22, "N": 0.0}
BANDS = [("critical", 9.0), ("high", 7.0), ("medium", 4.0), ("low", 0.1)]

# The base vector each weakness class is scored by, and that of any other class.
CWE_VECTORS = {
    "CWE-22": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-23": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-78": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
    "CWE-79": "AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N",
    "CWE-89": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
    "CWE-90": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
    "CWE-93": "AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N",
    "CWE-94": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
    "CWE-95": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
    "CWE-113": "AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N",
    "CWE-116": "AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N",
    "CWE-150": "AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N",
    "CWE-183": "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:L/A:N",
    "CWE-200": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-269": "AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H",
    "CWE-276": "AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H",
    "CWE-287": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
    "CWE-295": "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:N",
    "CWE-297": "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:N",
    "CWE-319": "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-323": "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-326": "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-327": "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-328": "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-329": "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-330": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-345": "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:H/A:N",
    "CWE-352": "AV:N/AC:L/PR:N/UI:R/S:U/C:H/I:H/A:H",
    "CWE-454": "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:L/A:N",
    "CWE-470": "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:H",
    "CWE-501": "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:L/A:N",
    "CWE-502": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
    "CWE-601": "AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N",
    "CWE-611": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:H",
    "CWE-614": "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-643": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-704": "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:L/A:N",
    "CWE-798": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
    "CWE-918": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-943": "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
    "CWE-1004": "AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N",
    "CWE-1333": "AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:H",
}
DEFAULT_VECTOR = "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N"


def metric(vector: str, name: str) -> str:
    """SQL for one metric's letter of a vector column (with or without the CVSS: prefix)."""
    return f"regexp_extract({vector}, '(^|/){name}:([A-Z])', 2)"


def _weight(vector: str, name: str, weights: dict[str, float]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in weights.items())
    return f"CASE {metric(vector, name)} {cases} ELSE CAST(0 AS DOUBLE) END"


def base_score_sql(vector: str) -> str:
    """SQL (Spark and DuckDB) for the base score of a vector column: specification 7.1 with its integer round-up."""
    changed = f"{metric(vector, 'S')} = 'C'"
    lost = " * ".join(f"(1 - {_weight(vector, m, IMPACT)})" for m in ("C", "I", "A"))
    iss = f"(1 - {lost})"
    impact = f"(CASE WHEN {changed} THEN 7.52 * ({iss} - 0.029) - 3.25 * power({iss} - 0.02, 15) ELSE 6.42 * {iss} END)"
    privileges = f"(CASE WHEN {changed} THEN {_weight(vector, 'PR', PR_CHANGED)} ELSE {_weight(vector, 'PR', PR_UNCHANGED)} END)"
    ease = f"(8.22 * {_weight(vector, 'AV', AV)} * {_weight(vector, 'AC', AC)} * {privileges} * {_weight(vector, 'UI', UI)})"
    raw = f"least((CASE WHEN {changed} THEN 1.08 ELSE 1.0 END) * ({impact} + {ease}), 10.0)"
    hundred = f"CAST(round(CAST({raw} AS DOUBLE) * 100000) AS BIGINT)"
    up = f"(CASE WHEN {hundred} % 10000 = 0 THEN {hundred} / 100000.0 ELSE (floor({hundred} / 10000.0) + 1) / 10.0 END)"
    return f"(CASE WHEN {impact} <= 0 THEN CAST(0 AS DOUBLE) ELSE CAST({up} AS DOUBLE) END)"


def base_score(vector: str) -> Column:
    return F.expr(base_score_sql(vector))


def band_sql(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {low} THEN '{name}'" for name, low in BANDS) + " ELSE 'none' END"


def band(score: str) -> Column:
    return F.expr(band_sql(score))


def vectors(spark: SparkSession) -> DataFrame:
    """cwe, vector, score: the table of fixed size that candidates are joined to."""
    return spark.createDataFrame(list(CWE_VECTORS.items()), "cwe string, vector string").withColumn("score", base_score("vector"))


def with_vector(df: DataFrame, ids: str = "cwe_ids") -> DataFrame:
    """df with cvss_vector and cvss_score of its worst weakness class (of equal scores the larger vector), by array
    lookup in a literal map: no join, no shuffle."""
    table = F.create_map(*[x for c, v in CWE_VECTORS.items() for x in (F.lit(c), F.lit(v))])
    known = F.filter(F.transform(F.col(ids), lambda c: F.element_at(table, c)), lambda v: v.isNotNull())
    every = df.withColumn("_vectors", F.when(F.size(known) > 0, F.array_distinct(known)).otherwise(F.array(F.lit(DEFAULT_VECTOR))))
    scored = F.expr(f"transform(_vectors, v -> struct({base_score_sql('v')} AS score, v AS vector))")
    best = every.withColumn("_best", F.array_max(scored))
    return best.select(*df.columns, F.col("_best.vector").alias("cvss_vector"), F.col("_best.score").alias("cvss_score"))
