"""Why no entry reaches a sink: overrides by closure, ends of its callers, and a table of outcomes with precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut
from .discovery import ends
from .references import reflective_files

# How many ends, and how many files with the name as a literal, are named; all are counted.
ENDS, FILES = 4, 2
OUTCOMES = ("no method", "startup", "overrides", "ends", "internal", "callback", "unused")


def overriding(methods: DataFrame, ancestors: DataFrame) -> DataFrame:
    """methods with ``overrides``: marked as such, or declared with the same name and arity by one of the owner's ancestors."""
    declared = methods.where("owner <> ''").select(F.col("owner").alias("ancestor"), "name", "arity").distinct()
    family = ancestors.select(F.col("type").alias("owner"), "ancestor").join(declared, "ancestor").select("owner", "name", "arity").distinct().withColumn("_declared", F.lit(True))
    out = methods.join(family, ["owner", "name", "arity"], "left")
    return out.withColumn("overrides", F.coalesce("marked", F.lit(False)) | F.col("_declared").isNotNull()).drop("_declared")


def _more(n: Column, shown: int) -> Column:
    return F.when(n > shown, F.concat(F.lit(" (+"), (n - shown).cast("string"), F.lit(" more)"))).otherwise("")


def unreachable_notes(sinks: DataFrame, methods: DataFrame, edges: DataFrame, literals: DataFrame, cap: int | None = None) -> DataFrame:
    """sink, outcome, note for sinks (sink, node; null where no method is around the sink) that no entry reaches.

    methods: node, file, owner, name, supertypes (array), anonymous, overrides, one row a node; edges: caller, callee, seq; literals: literal, file.
    The first outcome that fits counts: **no method**; **startup**, all ends of its callers are called main; **overrides**, some end
    overrides a supertype's method, so that type's users call it; **ends**, the others are listed; **internal**, its callers are only
    called by each other; **callback**, nothing calls it and it overrides or belongs to an anonymous type; **unused**.  Where a name may be
    looked up by text, files that hold it as a literal are named.  Callers are followed as far as they go; cap: only until a sink's search has
    seen so many, for readers with a fixed budget, so that ends further off are not known and a sink without nearer ones is internal."""
    facts = cut(methods.select("node", "file", "owner", "name", "supertypes", "anonymous", "overrides"), "methods")
    known = sinks.where("node IS NOT NULL")
    label = F.concat(F.when(F.col("owner") != "", F.concat("owner", F.lit("."))).otherwise(""), "name", F.lit("() in "), "file")
    told = cut(ends(known.select(F.col("node").alias("start"), "node").distinct(), edges, cap), "ends").join(facts.withColumnRenamed("node", "leaf"), "leaf")
    order = F.struct("depth", "chain")
    wide = F.col("overrides") & (F.size("supertypes") > 0)
    # as many of the first as are named, whatever the number of ends: lists are cut before they are merged
    first = told.groupBy("start").agg(
        F.count("*").alias("n_ends"), F.bool_and(F.col("name") == "main").alias("all_main"), F.bool_or(wide).alias("some_override"),
        F.min_by("name", F.when(wide, order)).alias("override_name"), F.array_sort(F.collect_set(F.when(wide, F.col("supertypes")))).alias("types"),
    )
    nth = F.row_number().over(Window.partitionBy("start").orderBy("depth", "chain"))
    named = told.select("start", label.alias("label"), nth.alias("nth")).where(F.col("nth") <= ENDS).groupBy("start").agg(F.array_sort(F.collect_list(F.struct("nth", "label"))).alias("named"))
    called = edges.where("caller <> callee").select(F.col("callee").alias("node"), F.lit(True).alias("called")).distinct()
    rows = sinks.join(facts, "node", "left").join(called, "node", "left").join(first.withColumnRenamed("start", "node"), "node", "left").join(named.withColumnRenamed("start", "node"), "node", "left")
    outcome = (
        F.when(F.col("node").isNull(), "no method")
        .when(F.col("called") & F.col("all_main"), "startup")
        .when(F.col("called") & F.col("some_override"), "overrides")
        .when(F.col("called") & (F.col("n_ends") > 0), "ends")
        .when(F.col("called"), "internal")
        .when(F.col("overrides") | F.col("anonymous"), "callback")
        .otherwise("unused")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("looked_up", F.when(F.col("outcome") == "overrides", F.col("override_name")).when(F.col("outcome").isin("callback", "unused"), F.col("name")))
    wanted = rows.where("looked_up IS NOT NULL").select(F.col("looked_up").alias("name")).distinct()
    files = reflective_files(wanted, literals.join(wanted.withColumnRenamed("name", "literal"), "literal", "left_semi"), FILES).select(F.col("name").alias("looked_up"), "files", "more")
    rows = rows.join(files, "looked_up", "left")
    text = F.concat(
        F.when(F.col("outcome") == "no method", "No method is around this line.")
        .when(F.col("outcome") == "startup", F.concat(F.lit("Runs at startup only; all callers begin at "), F.array_join(F.transform("named", lambda x: x["label"]), ", "), F.lit(".")))
        .when(F.col("outcome").isin("overrides", "ends"), F.concat(F.lit("No entry within reach; callers begin at "), F.array_join(F.transform("named", lambda x: x["label"]), "; "), _more(F.col("n_ends"), ENDS), F.lit(".")))
        .when(F.col("outcome") == "internal", "Only called by internal code that no entry reaches.")
        .when(F.col("outcome") == "callback", F.concat(F.lit("Nothing calls "), "name", F.lit("(); its type's users may, as a callback.")))
        .otherwise(F.concat(F.lit("Nothing calls "), "name", F.lit("(); unused, or called by name."))),
        F.when(F.col("outcome") == "overrides", F.concat(F.lit(" Overridden types: "), F.array_join(F.array_sort(F.array_distinct(F.flatten("types"))), ", "), F.lit("."))).otherwise(""),
        F.when(F.col("files") != "", F.concat(F.lit(" Named as text in "), F.replace(F.col("files"), F.lit(","), F.lit(", ")), F.when(F.col("more") > 0, F.concat(F.lit(" (+"), F.col("more").cast("string"), F.lit(" more)"))).otherwise(""), F.lit("."))).otherwise(""),
    )
    return rows.select("sink", "outcome", text.alias("note"))
