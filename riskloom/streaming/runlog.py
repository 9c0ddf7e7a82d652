"""Run logs, progress, heartbeats: stateful pieces, for batch tables and for Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ordered import last_value, ranked

RETAINED = 2000
RUNNING = ["queued", "ingesting", "scanning", "indexing", "verifying", "translating", "reporting", "paused"]


def since(log: DataFrame, after: int, scan: int | None = None) -> DataFrame:
    """Lines after a sequence number, of one scan if given."""
    out = log.where(F.col("seq") > after)
    return out if scan is None else out.where(F.col("scan_id") == scan)


def mark(log: DataFrame) -> DataFrame:
    """The high-water mark, of all lines whatever the filter."""
    return log.agg(F.max("seq").alias("mark"))


def retained(log: DataFrame, n: int = RETAINED) -> DataFrame:
    """The last n lines: a top-n, merged from each partition's own."""
    return log.orderBy(F.desc("seq")).limit(n)


def progress(events: DataFrame) -> DataFrame:
    """scan_id, stage (the last by ts, seq), done (events so far).  Also a streaming aggregation."""
    return events.groupBy("scan_id").agg(F.max_by("stage", F.struct("ts", "seq")).alias("stage"), F.count("*").alias("done"))


def sessions(beats: DataFrame, idle: int) -> DataFrame:
    """page, session (from 1), beats, seconds (half ones to the even neighbour): runs of heartbeats with no gap beyond idle seconds.  A page of any
    size is spread over tasks."""
    each = beats.select("page", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "seq")
    order = [F.col("us"), F.col("seq")]
    each = last_value(each, ["page"], order, "us", "before", ahead=True)
    each = each.withColumn("new", F.when(F.col("us") - F.col("before") <= idle * 1_000_000, 0).otherwise(1))
    each = ranked(each, ["page"], order, "place", {"session": "new"})
    return each.groupBy("page", "session").agg(F.count("*").alias("beats"), F.rint((F.max("us") - F.min("us")) / 1e6).cast("long").alias("seconds"))


def heartbeat_windows(stream: DataFrame, idle: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """Streaming form of sessions: page, start, end, beats, closed by the watermark."""
    return stream.withWatermark("ts", late).groupBy("page", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("beats")).select("page", "w.start", "w.end", "beats")


def stage_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streaming tumbling counts of events for each stage."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count("*").alias("n")).select("w.start", "stage", "n")


def without_repeats(stream: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Streaming: a record that several loggers hand on is kept once."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["scan_id", "text"])


def whole_lines(stream: DataFrame) -> DataFrame:
    """Streaming: writer, line, from text fragments (writer, seq, fragment): what follows a writer's last newline waits in its state."""

    def run(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        pending = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("seq")
        *lines, pending = (pending + "".join(rows["fragment"])).split("\n")
        state.update((pending,))
        yield pd.DataFrame({"writer": [key[0]] * len(lines), "line": lines})

    return stream.groupBy("writer").applyInPandasWithState(run, "writer string, line string", "pending string", "append", "NoTimeout")


def retained_each(lines: DataFrame, order: list[str], n: int = RETAINED) -> DataFrame:
    """lines (log, and what they carry) numbered from 1 in each log as ``seq``, and of those the last n of each log: what retain_stream holds after the
    same lines.  Numbers come from ranges with a carry, so a log of any size is spread over tasks."""
    placed = ranked(lines, ["log"], [F.col(c) for c in order], "seq")
    last = placed.groupBy(F.col("log").alias("_log")).agg(F.max("seq").alias("_last"))
    return placed.join(last, F.col("log").eqNullSafe(F.col("_log"))).where(F.col("seq") > F.col("_last") - n).drop("_log", "_last")


class _Ring(StatefulProcessor):
    """A log's last lines in state, keyed by their number, and the number of the next one."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "seq long")
        self.ring = handle.getMapState("ring", "seq long", "at long, text string, scan_id string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        new = pd.concat(list(rows)).sort_values("at", kind="stable")
        first = self.next.get()[0] if self.next.exists() else 1
        after = first + len(new)
        # lines that would be pushed out by others of their own batch never enter the ring
        for seq in range(max(1, first - self.n), min(first, after - self.n)):
            self.ring.removeKey((seq,))
        keep = new.tail(self.n)
        for seq, (at, text, scan) in enumerate(zip(keep["at"], keep["text"], keep["scan_id"], strict=True), after - len(keep)):
            self.ring.updateValue((seq,), (int(at), text, scan))
        self.next.update((after,))
        yield pd.DataFrame({"log": [key[0]] * len(new), "seq": range(first, after), "at": new["at"].tolist(), "text": new["text"].tolist(), "scan_id": new["scan_id"].tolist()})

    def close(self) -> None:
        pass


def retain_stream(stream: DataFrame, n: int = RETAINED) -> DataFrame:
    """Streaming: lines (log, at, text, scan_id) numbered in each log by arrival, within a micro-batch by at: log, seq, at, text, scan_id.

    State holds the last n lines of each log and its next number; older ones are evicted, and numbering goes on past them and over restarts from
    the checkpoint.  What is retained is read from there (``retained_state``).  The state store must be RocksDB (STORE).  A micro-batch's lines of
    one log pass one task: bound them by the source's options.  A null log is a log of its own."""
    return stream.groupBy("log").transformWithStateInPandas(statefulProcessor=_Ring(n), outputStructType="log string, seq long, at long, text string, scan_id string", outputMode="Append", timeMode="None")


#: The state store that retain_stream needs: setting and value.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def retained_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """log, seq, at, text, scan_id: the lines that the state of a stopped retain_stream holds."""
    ring = spark.read.format("statestore").option("stateVarName", "ring").load(checkpoint)
    return ring.select("key.log", F.col("user_map_key.seq").alias("seq"), "user_map_value.at", "user_map_value.text", "user_map_value.scan_id")


def tag_by_scan(lines: DataFrame, scans: DataFrame) -> DataFrame:
    """Each line (ts) with the scan begun last before it, if it lies in that scan's interval [start, end): an as-of join by a running last
    value over both tables, which is spread over ranges of time."""
    us = lambda c: F.unix_micros(c)
    s = scans.select(us(F.col("start")).alias("_us"), F.struct("scan_id", "end").alias("_scan"), F.lit(0).alias("_line"))
    l_ = lines.withColumn("_us", us(F.col("ts"))).withColumn("_line", F.lit(1))
    both = last_value(l_.unionByName(s, allowMissingColumns=True), [], [F.col("_us"), F.col("_line"), F.col("_scan.end"), F.col("_scan.scan_id")], "_scan", "_at").where("_line = 1")
    return both.withColumn("scan_id", F.when(F.col("ts") < F.col("_at.end"), F.col("_at.scan_id"))).select(*lines.columns, "scan_id")


def deadline(last_beat: float, now: float, closing: bool, idle: float = 20.0, grace: float = 8.0) -> float:
    """When a page counts as gone: idle seconds after its last beat; closing pulls that in to grace seconds from now, never out."""
    at = last_beat + idle
    return min(at, now + grace) if closing else at


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON lines (writer, seq, fragment) landing in a folder."""
    return spark.readStream.schema("writer string, seq long, fragment string").json(path)
