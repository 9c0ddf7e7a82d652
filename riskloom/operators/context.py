"""What a verifier is shown about a sink: windows, the code along the path, and why no entry was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import numbered

# Lines around a sink, the longest method shown whole, its head otherwise, lines for all hops of a path.
WINDOW, WHOLE, HEAD = 15, 120, 12
PATH_LINES, HOP_MIN, HOP_MAX = 240, 10, 40


def method_window(lines: Column, start: Column, end: Column, at: Column) -> Column:
    """A method's lines: all of them up to WHOLE, else its head and the lines around the sink, saying how many are left out."""
    low, high = F.greatest(start + HEAD, at - WINDOW), F.least(end, at + WINDOW)
    left_out = low - (start + HEAD)
    note = F.when(left_out > 0, F.concat(F.lit("\n... "), left_out.cast("string"), F.lit(" lines omitted ...\n"))).otherwise("\n")
    cut = F.concat(numbered(lines, start, start + HEAD - 1), note, numbered(lines, low, high))
    return F.when(end - start + 1 <= WHOLE, numbered(lines, start, end)).otherwise(cut)


def hop_budget(hops: Column) -> Column:
    """Lines for each hop of a path of so many hops."""
    return F.greatest(F.lit(HOP_MIN), F.least(F.lit(HOP_MAX), F.floor(F.lit(PATH_LINES) / hops).cast("int")))


def prompt(template: str, **columns: Column) -> Column:
    """A template with {name} places filled from columns."""
    out, rest = [], template
    while rest:
        before, brace, rest = rest.partition("{")
        out.append(F.lit(before))
        if brace:
            name, _, rest = rest.partition("}")
            out.append(F.coalesce(columns[name].cast("string"), F.lit("")))
    return F.concat(*out)


def callee_bodies(callees: DataFrame, methods: DataFrame, files: DataFrame) -> DataFrame:
    """sink, rank, text: the first lines (HOP_MAX) of each callee (sink, rank, method_seq); methods: method_seq, file, start, end; files: file, lines."""
    where = callees.join(methods.select("method_seq", "file", "start", "end"), "method_seq").join(files.select("file", "lines"), "file")
    return where.select("sink", "rank", numbered(F.col("lines"), F.col("start"), F.least("end", F.col("start") + HOP_MAX - 1)).alias("text"))


def classify_leaves(leaves: DataFrame, main: Column, shown: int = 4) -> DataFrame:
    """Why a start has no entry: unused (nothing calls it), all main, many leaves, or the few that are listed."""
    facts = leaves.withColumn("main", main).groupBy("start").agg(F.count("*").alias("n"), F.bool_and("main").alias("all_main"), F.min("leaf").alias("least"))
    nth = F.row_number().over(Window.partitionBy("start").orderBy("leaf"))  # a top-n: what is not shown is never gathered
    some = leaves.select("start", "leaf", nth.alias("nth")).where(F.col("nth") <= shown).groupBy("start").agg(F.array_sort(F.collect_list("leaf")).alias("some"))
    kind = F.when((F.col("n") == 1) & (F.col("least") == F.col("start")), "unused").when(F.col("all_main"), "all main").when(F.col("n") > shown, "many").otherwise("listed")
    return facts.join(some, "start").select("start", "n", kind.alias("class"), F.array_join("some", ",").alias("shown"))


def path_text(hops: DataFrame) -> DataFrame:
    """path_id, text: the code of each hop (path_id, hop from the sink 0.., lines, start, end), entry first, each within its budget."""
    size = hops.groupBy("path_id").agg(F.count("*").alias("hops"))
    cut = F.col("start") + hop_budget(F.col("hops")) - 1
    text = hops.join(size, "path_id").select("path_id", "hop", numbered(F.col("lines"), F.col("start"), F.least("end", cut)).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.negate("hop").alias("o"), "text")))
    return text.groupBy("path_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))
