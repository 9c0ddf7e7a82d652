"""Patterns that enclose and exclude, and taint, over span rows: no text of a method is searched, and no span meets another one by one.

Spans of a file are nested: two of them share nothing, or one holds the other.  So what is around a span is what is open where it begins, and
that is a running sum over the file's borders: one more where an outer span begins, one less where it ends.  The sum is made over
ranges with a carry (``ordered.ranked``), so a file of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import last_value, ranked


def around(spans: DataFrame, outers: dict[str, str]) -> DataFrame:
    """spans (span, file, start, end: half-open) with, for each name in outers, how many spans that its condition (SQL over spans' columns) holds
    for are around each: of equal ones all others count, a span is never around itself, and of spans with one start the longer is around
    the shorter.  An empty span lies at its place; an empty outer span is around nothing but empty ones there.  Rows whose file, start or end is null
    have none around them and are around nothing.  Repeated rows are spans of their own."""
    whole = F.col("file").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    is_outer = [F.coalesce(F.expr(c), F.lit(False)) for c in outers.values()]
    rows = spans.select(F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias("_row"), "file", "start", "end", *[o.alias(f"_is{i}") for i, o in enumerate(is_outer)], F.xxhash64(*[F.col(f"`{c}`") for c in spans.columns]).alias("_h"))
    known = rows.where(whole)
    n = range(len(outers))
    # at one place ends come first; of starts the longest, and of equal spans all that are outer before any is asked
    asks = known.select("file", F.struct(F.col("start").cast("long").alias("at"), F.lit(1).alias("kind"), (-F.col("end")).cast("long").alias("size"), F.lit(1).alias("role"), "_h").alias("_key"), *[F.lit(0).alias(f"_d{i}") for i in n], "_row", *[f"_is{i}" for i in n])
    none, flags = F.lit(None).cast(asks.schema["_row"].dataType), [F.lit(None).cast("boolean").alias(f"_is{i}") for i in n]
    any_ = known.where(" OR ".join(f"_is{i}" for i in n))
    begins = any_.select("file", F.struct(F.col("start").cast("long").alias("at"), F.lit(1).alias("kind"), (-F.col("end")).cast("long").alias("size"), F.lit(0).alias("role"), "_h").alias("_key"), *[F.col(f"_is{i}").cast("int").alias(f"_d{i}") for i in n], none.alias("_row"), *flags)
    ends = any_.select("file", F.struct(F.col("end").cast("long").alias("at"), F.when(F.col("start") == F.col("end"), 2).otherwise(0).alias("kind"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("role"), "_h").alias("_key"), *[(-F.col(f"_is{i}").cast("int")).alias(f"_d{i}") for i in n], none.alias("_row"), *flags)
    swept = ranked(asks.unionAll(begins).unionAll(ends), ["file"], [F.col("_key")], "_place", {f"_open{i}": f"_d{i}" for i in n}).where("_row IS NOT NULL")
    told = swept.select("_row.*", *[(F.col(f"_open{i}") - F.col(f"_is{i}").cast("int")).cast("long").alias(name) for i, name in enumerate(outers)])
    return told.unionAll(rows.where(~whole).select("_row.*", *[F.lit(0).cast("long").alias(name) for name in outers]))


def enclosed(hits: DataFrame, inside: str | None = None, not_inside: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """hits (span, file, start, end, ...) that lie in a span for which inside holds, and in none for which not_inside does; both are SQL over the columns of
    among (the spans around, by default the hits themselves, with the same columns)."""
    asked = {k: f"_outer AND ({c})" for k, c in (("_in", inside), ("_out", not_inside)) if c}
    if not asked:
        return hits
    both = hits.withColumn("_hit", F.lit(True)).withColumn("_outer", F.lit(among is None))
    if among is not None:
        both = both.unionByName(among.withColumn("_hit", F.lit(False)).withColumn("_outer", F.lit(True)), allowMissingColumns=True)
    out = around(both, asked).where("_hit")
    if inside:
        out = out.where("_in > 0")
    if not_inside:
        out = out.where("_out = 0")
    return out.select(*hits.columns)


def tainted_uses(given: DataFrame, uses: DataFrame) -> DataFrame:
    """uses (unit, name, at, ...) with ``tainted``: what the variable was last given before the use came from a source.

    given: unit, name, at (where the value ends), source - false for anything clean, sanitized values among it.  Both are dealt by unit, name and place,
    so a unit with very many assignments to one variable is no single task.  Of values that end at one place, a source counts; one that ends
    where the use stands counts too.  A use without any value before it, or with a null name or unit, is not tainted."""
    values = given.select("unit", "name", F.col("at").cast("long").alias("at"), F.coalesce("source", F.lit(False)).alias("_source"))
    asked = uses.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in uses.columns])).select("unit", "name", F.col("at").cast("long").alias("at"), F.lit(None).cast("boolean").alias("_source"), "_row")
    both = asked.unionByName(values, allowMissingColumns=True).withColumn("_use", F.col("_row").isNotNull())
    known = last_value(both.where("unit IS NOT NULL AND name IS NOT NULL"), ["unit", "name"], [F.col("at"), F.col("_use"), F.col("_source"), F.xxhash64("_row")], "_source", "_last").where("_use")
    told = known.select("_row.*", F.coalesce("_last", F.lit(False)).alias("tainted"))
    return told.unionAll(both.where("(unit IS NULL OR name IS NULL) AND _use").select("_row.*", F.lit(False).alias("tainted")))
