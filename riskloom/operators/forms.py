"""Allocation form: was a pointer got by ``new`` or by ``new[]``, followed through aliases, factories, members and callers of other files.

A node is a variable of a function, or what a function returns; a fact says that a form reaches a node.  Facts spread along assignments
(both ways, as either side may be released), returns and arguments until nothing new is reached; what has reached a node is its place
in a lattice of four: unknown, one of the two forms, conflict.  All that reaches it must agree.

Nearer evidence goes first: (1) assignments of the function itself and what its factories return, (2) where that says nothing,
assignments to the same symbol anywhere in the file, on which constructors and destructors must agree, (3) where that says nothing
either, what callers hand in.  A node that an earlier step has settled, in conflict or not, takes nothing from a later one.

Variables that a function copies to each other have the same facts in every step, as copies go both ways.  So each such class is one node while
facts spread, and its variables get its form in the end.  All tables are dealt by the nodes' functions: classes are found, and settled nodes
left out, where the rows lie; only a step's new facts, and what crosses from one function to another, move.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import Seen, cut, joined_in_place

#: Beyond so many steps the input is no program; an error is better than a wrong answer.  Edges followed in one step.
MOST, HOPS = 100_000, 3


def variable(scope: str, symbol: str) -> Column:
    return F.concat(F.lit("v|"), F.col(scope), F.lit("|"), F.col(symbol))


def result(function: str) -> Column:
    return F.concat(F.lit("r|"), F.col(function))


def dealt(df: DataFrame, name: str = "node", at: int = 2) -> DataFrame:
    """df dealt by ``home``, the function of a node (of a function's name, with at=1) up to the first sign that parts names in nodes.

    It is always told anew: Spark 4.1 takes a union of bucketed tables for dealt as they are, though it only strings their buckets together."""
    return df.withColumn("home", F.split_part(F.col(name), F.lit("|"), F.lit(at))).repartition("home")


def classes(pairs: DataFrame) -> DataFrame:
    """home, node, one: for each node of pairs (home, a, b; a < b; dealt by home) the least that any number of pairs, taken either way, links it with.

    Large-star and small-star contraction: nodes are hung below the least of their neighbours until each hangs below one that hangs below none.
    Pairs lie within a home, so no step moves a row."""
    ends = lambda df, *ways: df.select("home", F.inline(F.array(*(F.struct(F.expr(x).alias("a"), F.expr(y).alias("b")) for x, y in ways)))).distinct()
    for _ in range(MOST):
        far = ends(pairs, ("a", "b"), ("b", "a")).withColumn("one", F.least("a", F.min("b").over(Window.partitionBy("home", "a")))).where("b > a").select("home", F.col("one").alias("a"), "b").distinct()
        near = far.withColumn("one", F.min("a").over(Window.partitionBy("home", "b")))
        pairs = cut(ends(near, ("one", "a"), ("one", "b")).where("a <> b"), "classes", ["home"], lies=True)
        hung = ends(pairs, ("a", "NULL"), ("b", "a")).groupBy("home", "a").agg(F.count("b").alias("n"), F.max(F.col("b").isNull()).alias("top"))
        if not hung.where("n > 1 OR n = 1 AND top").count():
            return cut(ends(pairs, ("a", "a"), ("b", "a")).select("home", F.col("a").alias("node"), F.col("b").alias("one")), "classes", ["home"], lies=True)
    raise RuntimeError("classes did not settle")


def spread(facts: DataFrame, edges: DataFrame, shut: DataFrame | None = None, deal: Callable[[DataFrame], DataFrame] = dealt) -> DataFrame:
    """home, node, form: facts (node, form) and all they reach over edges (home, node, dst; dealt by home), but for nodes in shut (home, node; dealt
    by home), which take nothing.  A node has as many facts as there are forms; only a step's new facts are joined and written, HOPS
    edges further at a time, and loops end it.  deal: puts ``home`` to rows (node, form) and deals them by it, as the edges were dealt."""
    keys = ["home", "node", "form"]

    def met(df):
        df = deal(df).select(*keys).distinct()
        return df if shut is None else df.join(shut.select("home", "node"), ["home", "node"], "left_anti")

    new = cut(met(facts.where("node IS NOT NULL AND form IS NOT NULL")), "facts", ["home"], lies=True)
    known, seen = new, Seen(keys, ["home"])
    seen.add(new, new.count())
    for _ in range(MOST):
        hop, step = new, None
        for _ in range(HOPS):
            hop = met(hop.join(edges, ["home", "node"]).select(F.col("dst").alias("node"), "form"))
            step = hop if step is None else step.unionAll(hop)
        new = cut(seen.without(deal(step).select(*keys).distinct()), "facts", ["home"], lies=True)
        n = new.count()
        if not n:
            return known
        known = known.unionAll(new)
        seen.add(new, n)
    raise RuntimeError("facts did not settle")


def settled(facts: DataFrame) -> DataFrame:
    """home, node, form: the one form that reached a node, or ``conflict``; dealt by home."""
    return dealt(facts.select("node", "form")).groupBy("home", "node").agg(F.when(F.min("form") == F.max("form"), F.min("form")).otherwise("conflict").alias("form"))


def allocation_form(news: DataFrame, copies: DataFrame, results: DataFrame, returns: DataFrame, params: DataFrame, args: DataFrame, files: DataFrame) -> DataFrame:
    """node, form of every variable (``v|function|symbol``) and result (``r|function``) that a form reaches; others are unknown.

    news: function, symbol, form; copies: function, dst_symbol, src_symbol; results: function, symbol, called (symbol = called(...));
    returns: function, form, symbol, called (one of them not null); params: function, place, symbol; args: function, called, place, form,
    symbol (what is handed in: a new object or a variable); files: function, file.  Nulls in a name join nothing; repeated rows say nothing new."""
    with joined_in_place(news.sparkSession):
        return _form(news, copies, results, returns, params, args, files)


def _form(news, copies, results, returns, params, args, files):
    # classes of variables; a copy of a variable to itself, or to nothing, only names it
    named = copies.select("function", F.least("dst_symbol", "src_symbol").alias("a"), F.greatest("dst_symbol", "src_symbol").alias("b")).where("function IS NOT NULL AND a IS NOT NULL")
    named = cut(dealt(named, "function", 1).distinct(), "copies", ["home"], lies=True)
    alike = classes(named.where("a <> b").select("home", variable("function", "a").alias("a"), variable("function", "b").alias("b")))
    # what else is said of variables, with their classes
    one = lambda df: df.join(alike, ["home", "node"], "left").withColumn("one", F.coalesce("one", "node"))
    none = lambda kind: F.lit(None).cast(kind)
    at = args.schema["place"].dataType
    say = lambda df, kind, form=none("string"), called=none("string"), place=none(at): df.select(F.lit(kind).alias("kind"), "function", "symbol", form.alias("form"), called.alias("called"), place.cast(at).alias("place"))
    form, called, place = F.col("form"), F.col("called"), F.col("place")
    said = [say(news, "new", form), say(results, "result", called=called), say(returns, "return"), say(params, "param", place=place), say(args, "arg", called=called, place=place)]
    said = functools.reduce(DataFrame.unionAll, said).withColumn("node", variable("function", "symbol")).where("node IS NOT NULL")
    said = cut(one(dealt(said)), "said", ["home"], lies=True)
    of = lambda kind: said.where(F.col("kind") == kind)
    # (1) within functions and through results
    ways = (
        of("result").select(result("called").alias("node"), F.col("one").alias("dst"))
        .unionAll(of("return").select("one", result("function")))
        .unionAll(returns.where("called IS NOT NULL").select(result("called"), result("function")))
        .where("node IS NOT NULL AND dst IS NOT NULL AND node <> dst")
    )
    within = cut(dealt(ways).distinct(), "within", ["home"], lies=True)
    local = of("new").select(F.col("one").alias("node"), "form").unionAll(returns.where("form IS NOT NULL").select(result("function"), "form"))
    first = cut(settled(spread(local, within)), "first", ["home"], lies=True)
    # (2) the file's own assignments to a symbol, for variables of that name of which nothing is known
    there = cut(dealt(files.where("function IS NOT NULL AND file IS NOT NULL"), "function", 1).distinct(), "files", ["home"], lies=True)
    by_file = of("new").join(there, ["home", "function"]).select("file", "symbol", "form").distinct()
    copied = one(named.select("home", "function", F.explode(F.array("a", "b")).alias("symbol")).distinct().withColumn("node", variable("function", "symbol")))
    still = lambda df: df.join(first.select("home", F.col("node").alias("one")), ["home", "one"], "left_anti").join(there, ["home", "function"]).select("file", "symbol", "one")
    members = still(copied).unionAll(still(said.select("home", "function", "symbol", "one").distinct())).join(by_file, ["file", "symbol"]).select(F.col("one").alias("node"), "form")
    second = cut(first.unionAll(settled(spread(members, within, first))), "second", ["home"])
    # (3) what callers hand in; places are matched by equality, and a parameter takes from all its callers at once
    taken = of("param").select(F.col("function").alias("called"), "place", F.col("one").alias("dst"))
    handed = of("arg").select(F.col("one").alias("node"), "called", "place").join(taken, ["called", "place"]).where("node <> dst").select("node", "dst")
    ways = cut(dealt(within.select("node", "dst").unionAll(handed)).distinct(), "ways", ["home"], lies=True)
    both = F.explode(F.when(F.col("form") == "conflict", F.array(F.lit("array"), F.lit("scalar"))).otherwise(F.array("form"))).alias("form")
    known = ways.join(second, ["home", "node"]).select(F.col("dst").alias("node"), both)
    direct = args.where("form IS NOT NULL").select("called", "place", "form").join(taken, ["called", "place"]).select(F.col("dst").alias("node"), "form")
    third = settled(spread(direct.unionAll(known), ways, second))
    every = lambda df: df.join(alike.select("home", F.col("one").alias("node"), F.col("node").alias("like")), ["home", "node"], "left").select(F.coalesce("like", "node").alias("node"), "form")
    return cut(every(second).unionAll(every(third)), "forms", ["node"])


def release_mismatch(uses: DataFrame, forms: DataFrame) -> DataFrame:
    """uses (function, symbol, released, and what else they carry) with ``form`` - unknown where nothing reaches the variable - and ``confirmed``:
    the form is one of the two, and not the one that is released."""
    got = uses.withColumn("node", variable("function", "symbol")).join(forms.select("node", F.col("form").alias("_form")), "node", "left").withColumn("form", F.coalesce("_form", F.lit("unknown")))
    return got.withColumn("confirmed", F.col("form").isin("array", "scalar") & (F.col("form") != F.col("released"))).drop("node", "_form")
