"""Include resolution: which file an ``#include "..."`` means, and what is visible through it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .references import visible_macros

#: An include line's path.
INCLUDE = r'^\s*#\s*include\s*"([^"]+)"'


def normal_path(path: Column) -> Column:
    """A path without empty segments, dots and climbing; what climbs above its root keeps its leading ``..`` and names no file."""
    up = lambda done: (F.size(done) > 0) & (F.element_at(done, -1) != "..")
    step = lambda done, x: F.when((x == "") | (x == "."), done).when((x == "..") & up(done), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def includes_of(lines: DataFrame) -> DataFrame:
    """file, line_no, included of the include lines of lines (file, line_no, line)."""
    return lines.withColumn("included", F.regexp_extract("line", INCLUDE, 1)).where("included <> ''").select("file", "line_no", "included")


def include_edges(includes: DataFrame, files: DataFrame) -> DataFrame:
    """includes (file, included) with ``target``: the first of the path as seen from the file's own folder and from the root that is one of files
    (file), and ``found``: own, root or none.

    Both readings of an include are looked up by equality in one join with the files; a popular header is one row there.  Absolute paths name no file
    of the project; a file may include itself; an include of a null file or path has no target; repeated rows keep their number."""
    folder = F.regexp_replace("file", r"[^/]*$", "")
    given = includes.select("file", "included").groupBy("file", "included").agg(F.count("*").alias("_times"))
    bare = F.col("file").isNotNull() & ~F.col("included").startswith("/")
    read = given.select("*", F.inline(F.array(F.struct(F.lit(1).alias("_rank"), F.when(bare, normal_path(F.concat(folder, "included"))).alias("_path")), F.struct(F.lit(2).alias("_rank"), F.when(bare, normal_path(F.col("included"))).alias("_path")))))
    there = files.select(F.col("file").alias("_path"), F.lit(True).alias("_there")).distinct()
    met = read.join(there, "_path", "left")
    best = met.groupBy("file", "included", "_times").agg(F.min(F.when(F.col("_there"), F.struct("_rank", "_path"))).alias("_best"))
    found = F.when(F.col("_best._rank") == 1, "own").when(F.col("_best._rank") == 2, "root").otherwise("none")
    rows = best.select("file", "included", F.col("_best._path").alias("target"), found.alias("found"), F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))).alias("_n"))
    return rows.drop("_n")


def included_macros(includes: DataFrame, files: DataFrame, macros: DataFrame) -> DataFrame:
    """file, name: macros (file, name) of a file and of all that it includes, directly or not, in circles or not."""
    edges = include_edges(includes, files).where("target IS NOT NULL").select("file", F.col("target").alias("included")).distinct()
    return visible_macros(edges, macros)
