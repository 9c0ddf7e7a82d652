"""Running a scan's stages from the driver: status and progress callbacks, pause, cancellation, and which status may follow which."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import last_value, ranked

# Statuses in their order, those that end a scan, and what an upload may be.
STAGES = ["queued", "ingesting", "scanning", "indexing", "verifying", "translating", "reporting", "done"]
ENDS = ["done", "failed", "cancelled"]
UPLOAD_SUFFIX, UPLOAD_BYTES = ".zip", 200 << 20
LONG_PATH = 260


class Cancelled(Exception):
    """The scan was cancelled; its running jobs are gone."""


def run_stages(spark: SparkSession, stages: Iterable[tuple[str, Callable[[], object]]], on_status: Callable[[str], None] = lambda s: None, cancelled: Callable[[], bool] = lambda: False, paused: Callable[[], bool] = lambda: False, poll: float = 0.5) -> list:
    """Results of the stages (name, function), one after the other.  Between stages a pause is waited for; a cancellation also ends the
    jobs of the running stage, as soon as it is seen.  on_status hears each stage's name, paused, and done, cancelled or failed in the end."""
    context, group, out = spark.sparkContext, f"scan-{uuid.uuid4().hex}", []
    stop, hit = threading.Event(), threading.Event()

    def watch() -> None:
        while not stop.wait(poll):
            if cancelled():
                hit.set()
                context.cancelJobGroup(group)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    context.setJobGroup(group, "stages of a scan", interruptOnCancel=True)
    try:
        for name, stage in stages:
            if paused():
                on_status("paused")
            while paused() and not cancelled():
                time.sleep(poll)
            if cancelled():
                raise Cancelled(name)
            on_status(name)
            out.append(stage())
        on_status("done")
        return out
    except BaseException as e:
        gone = isinstance(e, Cancelled) or hit.is_set()
        on_status("cancelled" if gone else "failed")
        if gone and not isinstance(e, Cancelled):
            raise Cancelled(name) from e
        raise
    finally:
        stop.set()
        watcher.join()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(key, None)


def may_follow(before: Column, after: Column, stages: list[str] | None = None) -> Column:
    """Whether a status may follow another: the same or a later stage, pause and back, or an end; nothing follows an end."""
    stages = STAGES if stages is None else stages
    place = lambda c: F.array_position(F.array(*[F.lit(s) for s in stages]), c)
    moving = (place(after) > 0) & ((place(before) == 0) | (place(after) >= place(before)))
    return ~F.coalesce(before.isin(ENDS), F.lit(False)) & (before.isNull() | (after == "paused") | after.isin(ENDS) | moving)


def transitions(events: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """events (scan_id, seq, status) with the status before and whether this one may follow it; a scan of any length is spread over tasks."""
    out = last_value(events, ["scan_id"], [F.col("seq")], "status", "before", ahead=True)
    return out.withColumn("allowed", may_follow(F.col("before"), F.col("status"), stages))


def accepted_upload(path: Column, size: Column) -> Column:
    """Only archives by suffix, up to a size."""
    return F.lower(path).endswith(UPLOAD_SUFFIX) & (size <= UPLOAD_BYTES)


def long_paths(files: DataFrame, ignored: list[str], limit: int = LONG_PATH, path: str = "path") -> DataFrame:
    """Files whose path some systems can't open, but for those below folders that are ignored anyway."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    below = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in ignored]).cast("array<string>"))
    return files.where((F.length(path) >= limit) & ~F.coalesce(below, F.lit(False)))


def text_table(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """line, text: rows as aligned text, numbers to the right; line 0 has the names.  Widths come from one aggregation."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal")}
    shown = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns], F.struct(*order).alias("_order"))
    width = df.agg(*[F.greatest(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)), F.lit(len(c))).alias(c) for c in columns]).collect()[0]
    cell = lambda c: (F.lpad if c in numeric else F.rpad)(c, width[c], " ")
    rows = ranked(shown, [], [F.col("_order")], "line").select("line", F.rtrim(F.concat_ws("  ", *[cell(c) for c in columns])).alias("text"))
    head = "  ".join(c.rjust(width[c]) if c in numeric else c.ljust(width[c]) for c in columns).rstrip()
    return rows.unionAll(df.sparkSession.createDataFrame([(0, head)], "line long, text string"))
