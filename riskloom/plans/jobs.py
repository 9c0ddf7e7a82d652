"""The two jobs as queries: each is run twice into one new folder, and the whole output is read back."""

from __future__ import annotations

import uuid

from jobs import incremental_scan, risk_report

from ..functions.storage import shared_dir
from ..operators import analytics as A
from .queries import _PRINT, MERGED, SCORED

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark, job: str) -> str:
    return f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"


@query(f"""WITH {MERGED} SELECT dedup_key, doc_id, sink_file AS file, sink_line AS line, rule_id, severity, array_to_string(list_sort(ids), ',') AS cwe_ids, array_to_string(rule_ids, ',') AS rule_ids,
array_to_string(messages, ',') AS messages, mode AS verification_mode, confidence, report_id AS source, 0 AS batch FROM merged""")
def job1_incremental_scan(spark, sf_dir):
    at = _folder(spark, "job1")
    for _ in range(2):
        incremental_scan.run(spark, f"{sf_dir}/documents.parquet", f"{at}/candidates", f"{at}/checkpoint")
    return incremental_scan.read(spark, f"{at}/candidates").selectExpr(
        "dedup_key", "doc_id", "file", "line", "rule_id", "severity", "array_join(array_sort(cwe_ids), ',') AS cwe_ids", "array_join(rule_ids, ',') AS rule_ids", "array_join(messages, ',') AS messages", "verification_mode", "confidence", "source", "batch"
    )


_COPIES = f"""{MERGED},
prints AS (SELECT source || '/' || lang || '/d' || doc_id || '.txt' AS file, {_PRINT} AS fp FROM documents),
numbered AS (SELECT m.*, row_number() OVER (PARTITION BY p.fp, m.sink_line, list_sort(m.rule_ids) ORDER BY m.doc_id, m.sink_line, m.rule_id) AS nth,
             count(*) OVER (PARTITION BY p.fp, m.sink_line, list_sort(m.rule_ids)) AS copies FROM merged m JOIN prints p ON p.file = m.sink_file),
kept AS (SELECT * FROM numbered WHERE nth = 1)"""
_FIRST = SCORED.replace(MERGED, _COPIES).replace("FROM merged m LEFT JOIN lab", "FROM kept m LEFT JOIN lab")


def _counted(kind: str, names: list[str], column: str) -> str:
    values = ", ".join(f"({i}, '{x}')" for i, x in enumerate(names, 1))
    return f"""SELECT s.source AS report_id, '{kind}' AS kind, v.place, v.item, NULL AS rules, NULL AS verdict, NULL AS risk_level, NULL AS cvss_vector, NULL AS cvss_score, count(f.{column}) AS n
FROM (SELECT DISTINCT source FROM documents) s CROSS JOIN (VALUES {values}) v(place, item) LEFT JOIN scored f ON f.report_id = s.source AND f.{column} = v.item GROUP BY s.source, v.place, v.item"""


@query(f"""WITH {_FIRST}
SELECT report_id, 'finding' AS kind, row_number() OVER (PARTITION BY report_id ORDER BY CASE reachable WHEN 'yes' THEN 0 WHEN 'no' THEN 2 ELSE 1 END, CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'INFO' THEN 2 ELSE 3 END, doc_id, sink_line, rule_id) AS place,
       sink_file || ':' || sink_line AS item, array_to_string(rule_ids, ',') AS rules, verdict, risk_level, 'CVSS:3.1/' || cvss_vector AS cvss_vector, printf('%.1f', cvss_score) AS cvss_score, copies AS n FROM scored
UNION ALL SELECT report_id, 'rule', row_number() OVER (PARTITION BY report_id ORDER BY count(*) DESC, rule), rule, NULL, NULL, NULL, NULL, NULL, count(*) FROM (SELECT report_id, unnest(rule_ids) AS rule FROM scored) GROUP BY report_id, rule
UNION ALL {_counted("verdict", A.VERDICTS, "verdict")}
UNION ALL {_counted("risk", A.RISKS, "risk_level")}""")
def job2_risk_report(spark, sf_dir):
    at = _folder(spark, "job2")
    for _ in range(2):
        risk_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", at)
    return risk_report.read(spark, at)
