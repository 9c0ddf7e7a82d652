import json

from pyspark.sql import functions as F

from riskloom.streaming import runlog


def run(df, mode, name, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(90)
    return [tuple(r) for r in spark.table(name).collect()]


def test_whole_lines(spark, tmp_path):
    (tmp_path / "1.json").write_text("".join(json.dumps(x) + "\n" for x in [{"writer": "a", "seq": 1, "fragment": "he"}, {"writer": "a", "seq": 2, "fragment": "llo\nwor"}, {"writer": "b", "seq": 3, "fragment": "x\ny\n"}]))
    (tmp_path / "2.json").write_text(json.dumps({"writer": "a", "seq": 4, "fragment": "ld\n"}) + "\n")
    stream = spark.readStream.schema("writer string, seq long, fragment string").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    assert sorted(run(runlog.whole_lines(stream), "append", "lines", spark)) == [("a", "hello"), ("a", "world"), ("b", "x"), ("b", "y")]


def test_stream_aggregates(spark, tmp_path):
    rows = [("p", f"2024-01-01T00:00:{s:02d}", "scan", 1, "t") for s in (0, 10, 45)] + [("p", "2024-01-01T05:00:00", "index", 1, "t")]
    spark.createDataFrame(rows, "page string, ts string, stage string, scan_id int, text string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("page string, ts timestamp, stage string, scan_id int, text string").json(str(tmp_path / "in"))
    beats = {(str(r[1]), r[3]) for r in run(runlog.heartbeat_windows(stream), "complete", "beats", spark)}
    assert beats == {("2024-01-01 00:00:00", 2), ("2024-01-01 00:00:45", 1), ("2024-01-01 05:00:00", 1)}
    counts = {(r[1], r[2]) for r in run(runlog.stage_counts(stream), "complete", "counts", spark)}
    assert counts == {("scan", 3), ("index", 1)}
    assert len(run(runlog.without_repeats(stream), "append", "once", spark)) == 1


def test_sessions_of_half_seconds(spark):
    beats = [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:02.5", 2), ("b", "2024-01-01 00:00:00", 3), ("b", "2024-01-01 00:00:00.5", 4), ("c", "2024-01-01 00:00:00", 5), ("c", "2024-01-01 00:00:03.5", 6)]
    got = runlog.sessions(spark.createDataFrame(beats, "page string, ts string, seq int"), 20)
    assert {(r.page, r.beats, r.seconds) for r in got.collect()} == {("a", 2, 2), ("b", 2, 0), ("c", 2, 4)}


def test_log(spark):
    log = spark.createDataFrame([(i, i % 3, f"t{i}") for i in range(1, 11)], "seq int, scan_id int, text string")
    assert [r.seq for r in runlog.since(log, 5, 1).orderBy("seq").collect()] == [7, 10]
    assert runlog.mark(runlog.since(log, 0)).collect()[0].mark == 10
    assert sorted(r.seq for r in runlog.retained(log, 3).collect()) == [8, 9, 10]


def test_tag_by_scan(spark):
    at = lambda c: F.to_timestamp(c)
    lines = spark.createDataFrame([("a", "2024-01-01 10:30:00"), ("b", "2024-01-02 00:10:00"), ("c", "2024-01-02 01:00:00"), ("d", "2024-01-01 09:00:00")], "text string, t string").withColumn("ts", at("t")).drop("t")
    scans = spark.createDataFrame([(1, "2024-01-01 10:00:00", "2024-01-01 11:00:00"), (2, "2024-01-01 23:00:00", "2024-01-02 01:00:00")], "scan_id int, s string, e string").select("scan_id", at("s").alias("start"), at("e").alias("end"))
    assert {r.text: r.scan_id for r in runlog.tag_by_scan(lines, scans).collect()} == {"a": 1, "b": 2, "c": None, "d": None}


def test_deadline():
    assert runlog.deadline(100, 101, False) == 120 and runlog.deadline(100, 101, True) == 109 and runlog.deadline(100, 118, True) == 120


def test_retention_goes_on_over_a_restart(spark, tmp_path):
    at, mark, out = (str(tmp_path / x) for x in ("in", "mark", "out"))
    kind = "log string, at long, text string, scan_id string"
    before, sent = spark.conf.get(runlog.STORE[0]), []
    spark.conf.set(*runlog.STORE)

    def send(rows):
        sent.extend(rows)
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(at)

    def go():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(at)
        q = runlog.retain_stream(stream, 5).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r.log, r.seq, r.text or "") for r in spark.read.parquet(out).collect())

    try:
        send([("a", i, f"a{i}", "s1") for i in (3, 1, 2)] + [("b", 1, "b1", None)])
        assert go() == [("a", 1, "a1"), ("a", 2, "a2"), ("a", 3, "a3"), ("b", 1, "b1")]
        send([("a", i, f"a{i}", "s2") for i in range(4, 8)])
        send([("a", i, f"a{i}", "s2") for i in range(8, 20)] + [("b", 2, "b2", "x"), ("b", 3, None, "x")])
        assert go() == [("a", i, f"a{i}") for i in range(1, 20)] + [("b", 1, "b1"), ("b", 2, "b2"), ("b", 3, "")]
        held = sorted((r.log, r.seq, r.at, r.scan_id or "") for r in runlog.retained_state(spark, mark).collect())
        assert held == [("a", i, i, "s2") for i in range(15, 20)] + [("b", 1, 1, ""), ("b", 2, 2, "x"), ("b", 3, 3, "x")]
        twin = runlog.retained_each(spark.createDataFrame(sent, kind), ["at"], 5)
        assert sorted((r.log, r.seq, r.at, r.scan_id or "") for r in twin.collect()) == held
    finally:
        spark.conf.set(runlog.STORE[0], before)
