"""The two jobs over growing input, reruns, crashes and awkward rows."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import incremental_scan, risk_report
from jobs.common import beside, config
from riskloom.plans.jobs import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, batch string, kind string"


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def rows(df, *without):
    kept = [c for c in sorted(df.columns) if c not in without]
    return sorted((tuple(str(v) for v in r) for r in df.select(*kept).collect()))


def put(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def hit(n, text="mail me@x.org", source="s", lang="en"):
    return (n, text, lang, source, 1, "b", "k")


def test_scan_takes_what_is_new(spark, tmp_path):
    at, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    d = docs(spark)
    put(d.where("doc_id % 3 = 0"), at)
    first = incremental_scan.run(spark, at, out, mark)
    assert first["batches"] == 1 and first["documents"] == d.where("doc_id % 3 = 0").count() and first["candidates"] == incremental_scan.read(spark, out).count() > 0
    before = rows(incremental_scan.read(spark, out))
    assert incremental_scan.run(spark, at, out, mark) == {"batches": 0, "documents": 0, "candidates": 0}
    put(d.where("doc_id % 3 = 1"), at)
    put(d.where("doc_id % 3 = 2"), at)
    second = incremental_scan.run(spark, at, out, mark)
    assert second["documents"] == d.where("doc_id % 3 > 0").count()
    got = incremental_scan.read(spark, out)
    assert rows(got.where("batch = 0")) == before and {r.batch for r in got.select("batch").distinct().collect()} == {0, 1}
    incremental_scan.run(spark, f"{DATA}/documents.parquet", f"{out}2", f"{mark}2")
    assert rows(got, "batch") == rows(incremental_scan.read(spark, f"{out}2"), "batch")
    one = incremental_scan.DEFAULTS | config(beside(incremental_scan.__file__), incremental_scan.DEFAULTS) | {"files_per_batch": 1, "files_per_source": 1}
    assert incremental_scan.run(spark, at, f"{out}3", f"{mark}3", one)["batches"] == 3
    assert rows(got, "batch") == rows(incremental_scan.read(spark, f"{out}3"), "batch")


def test_scan_after_a_crash_between_write_and_mark(spark, tmp_path, monkeypatch):
    at, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    put(docs(spark).where("doc_id < 100"), at)
    incremental_scan.run(spark, at, out, mark)
    put(docs(spark).where("doc_id >= 100"), at)

    def dies(text, *a):
        if text.startswith("batch"):
            raise RuntimeError("lost")

    monkeypatch.setattr(incremental_scan.log, "info", dies)
    with pytest.raises(Exception, match="lost"):
        incremental_scan.run(spark, at, out, mark)
    monkeypatch.undo()
    torn = rows(incremental_scan.read(spark, out))
    assert incremental_scan.run(spark, at, out, mark)["batches"] == 1
    assert rows(incremental_scan.read(spark, out)) == torn and len(torn) == len(set(torn))


def test_scan_of_repeated_and_awkward_rows(spark, tmp_path):
    at, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    settings = incremental_scan.DEFAULTS | {"exclude_paths": ["vendor/**"]}
    assert incremental_scan.run(spark, f"{DATA}/documents.parquet", f"{out}0", f"{mark}0", settings)["batches"] == 1
    many = [hit(1), hit(1), hit(2, None), hit(3, ""), hit(None), hit(4, source=None), hit(5, lang=None), hit(6, source="vendor"), hit(7, "x " * 200_000 + "me@x.org")]
    put(spark.createDataFrame(many, DOCS), at)
    assert incremental_scan.run(spark, at, out, mark, settings)["documents"] == len(many)
    got = {(r.doc_id, r.source): r for r in incremental_scan.read(spark, out).collect()}
    assert set(got) == {(1, "s"), (None, "s"), (4, None), (5, "s"), (7, "s")}
    assert got[1, "s"].rule_ids == ["email", "email"]  # both rows of it, as rules that hit one place are merged with repeats
    put(spark.createDataFrame([hit(1), hit(1, "mail me@x.org\nand you@x.org"), hit(8)], DOCS), at)
    assert incremental_scan.run(spark, at, out, mark, settings)["candidates"] == 2
    later = incremental_scan.read(spark, out).where("batch = 1").collect()
    assert sorted((r.doc_id, r.line) for r in later) == [(1, 2), (8, 1)]
    put(spark.createDataFrame([], DOCS), at)
    assert incremental_scan.run(spark, at, out, mark, settings)["candidates"] == 0


def test_report_is_the_same_again(spark, tmp_path):
    out = f"{tmp_path}/out"
    told = risk_report.run(spark, f"{DATA}/documents.parquet", f"{DATA}/labels.parquet", out)
    first = rows(risk_report.read(spark, out))
    assert len(first) == told["rows"] and told["reports"] == docs(spark).select("source").distinct().count()
    assert risk_report.run(spark, f"{DATA}/documents.parquet", f"{DATA}/labels.parquet", out) == told
    assert rows(risk_report.read(spark, out)) == first


def test_report_of_some_sources(spark, tmp_path):
    at, out = f"{tmp_path}/in", f"{tmp_path}/out"
    settings = risk_report.DEFAULTS | {"files_per_report": 2}
    put(spark.createDataFrame([hit(1, source="a"), hit(2, source="b"), hit(3, source="c")], DOCS), at)
    run = lambda **more: risk_report.run(spark, at, f"{DATA}/labels.parquet", out, settings | more)
    assert run()["reports"] == 3
    found = lambda: sorted((r.report_id, r.item) for r in risk_report.read(spark, out).where("kind = 'finding'").collect())
    assert found() == [("a", "a/en/d1.txt:1")]  # b and c hold copies of it
    spark.createDataFrame([hit(1, "clean", source="a"), hit(2, source="b"), hit(2, source="d")], DOCS).coalesce(1).write.mode("overwrite").parquet(at)
    assert run(sources=["a", "d"])["reports"] == 2
    assert found() == []  # nothing old is left in a, and d holds a copy of what b, which was not asked for, has first
    have = {r.report_id for r in risk_report.read(spark, out).select("report_id").distinct().collect()}
    assert have == {"a", "b", "c", "d"}
    run()
    assert found() == [("b", "b/en/d2.txt:1")]
    assert {r.report_id for r in risk_report.read(spark, out).select("report_id").distinct().collect()} == {"a", "b", "d"}
    zero = risk_report.read(spark, out).where("report_id = 'a'").collect()
    assert sorted((r.kind, r.n) for r in zero) == [("risk", 0)] * 4 + [("verdict", 0)] * 5


def test_report_of_awkward_rows(spark, tmp_path):
    at, out, marks = (f"{tmp_path}/{x}" for x in ("in", "out", "marks"))
    many = [hit(1), hit(1), hit(2, None), hit(3, ""), hit(None), hit(4, source=None), hit(5, lang=None), hit(7, "x " * 200_000 + "you@x.org")]
    put(spark.createDataFrame(many, DOCS), at)
    put(spark.createDataFrame([(7, 1, 1, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, verdict string"), marks)
    risk_report.run(spark, at, marks, out, risk_report.DEFAULTS)
    got = {(r.item, r.verdict): r.n for r in risk_report.read(spark, out).where("kind = 'finding'").collect()}
    assert got["s/en/d7.txt:1", "yes"] == 1 and sum(got.values()) >= 3
    put(spark.createDataFrame([], DOCS), f"{at}0")
    assert risk_report.run(spark, f"{at}0", marks, f"{out}0", risk_report.DEFAULTS)["rows"] == 0


def test_command_line_and_config(tmp_path):
    odd = tmp_path / "odd.json"
    odd.write_text(json.dumps({"file_per_batch": 1}))
    with pytest.raises(ValueError, match="file_per_batch"):
        config(str(odd), incremental_scan.DEFAULTS)
    small = tmp_path / "small.json"
    small.write_text(json.dumps({"files_per_batch": 5}))
    args = [sys.executable, f"{ROOT}/jobs/incremental_scan.py", "--documents", f"{DATA}/documents.parquet", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", str(small)]
    done = subprocess.run(args, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "1 batches" in done.stderr and any(f.startswith("batch=") for f in os.listdir(tmp_path / "out"))


def test_registered_with_sql():
    assert set(QUERIES) == set(ORACLES) == {"job1_incremental_scan", "job2_risk_report"}
