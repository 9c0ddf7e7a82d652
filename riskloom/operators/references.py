"""References between relations: routes to handlers, statements to mappers, literals to files, calls to macros and types."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut, joined_in_place
from .forms import spread
from .graph import enclosing
from .ordered import last_value, ranked

#: A string literal that may name something.
LITERAL = r'"([A-Za-z_$][A-Za-z0-9_$]{2,63})"'


def apply_references(methods: DataFrame, refs: DataFrame, on: list[str], last: bool = False, only_blank: bool = False) -> DataFrame:
    """methods with entry_reason and definitive set by references on the given columns: of several the first (or last) by ref_seq, where
    the method is not definitive yet (or, only_blank, has no reason yet)."""
    pick = F.max_by if last else F.min_by
    one = refs.groupBy(*on).agg(pick("reason", "ref_seq").alias("new_reason"))
    out = methods.join(one, on, "left").withColumn("was", F.col("definitive"))
    known = F.col("new_reason").isNotNull()
    takes = known & (F.col("entry_reason").isNull() if only_blank else ~F.col("was"))
    out = out.withColumn("definitive", F.col("was") | (takes if only_blank else known))
    return out.withColumn("entry_reason", F.when(takes, F.col("new_reason")).otherwise(F.col("entry_reason"))).drop("new_reason", "was")


def apply_last(methods: DataFrame, refs: DataFrame, language: str = "cpp") -> DataFrame:
    """methods with entry_reason and definitive set by framework references (ref_seq, name, owner or blank, reason): of all that fit a method's
    name - and, where they name an owner, the short name of its owner - the last by ref_seq, whatever the method was before.  Only
    methods of one language (column language) are touched.  References are reduced to one a name and owner before they meet the methods."""
    short = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^.*::", "")
    last = refs.groupBy("name", short(F.col("owner")).alias("_owner")).agg(F.max(F.struct("ref_seq", "reason")).alias("_ref"))
    any_ = last.where("_owner = ''").select("name", F.col("_ref").alias("_any"), F.lit(language).alias("language"))
    own = last.where("_owner <> ''").select("name", "_owner", F.col("_ref").alias("_own"), F.lit(language).alias("language"))
    met = methods.withColumn("_owner", short(F.col("owner"))).join(any_, ["name", "language"], "left").join(own, ["name", "_owner", "language"], "left").withColumn("_ref", F.greatest("_any", "_own"))
    takes = F.col("_ref").isNotNull()
    out = met.withColumn("entry_reason", F.when(takes, F.col("_ref.reason")).otherwise(F.col("entry_reason"))).withColumn("definitive", F.col("definitive") | takes)
    return out.select(*methods.columns)


def link_by_suffix(statements: DataFrame, owners: DataFrame) -> DataFrame:
    """statement, owner: owners equal to a statement's dotted namespace or to a suffix of it.  The namespace's suffixes (one a dot) are
    joined by equality; nothing is compared by pattern."""
    parts = F.split("namespace", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    return statements.select("statement", suffix.alias("owner")).join(owners, "owner").select("statement", "owner")


def without_macros(calls: DataFrame, macros: DataFrame) -> DataFrame:
    """Calls of nothing that is a macro."""
    return calls.join(macros.select(F.col("name").alias("callee")).distinct(), "callee", "left_anti")


def literal_index(lines: DataFrame) -> DataFrame:
    """literal, file: identifier-shaped string literals and where they stand."""
    return lines.select("file", F.explode(F.regexp_extract_all("line", F.lit(LITERAL), 1)).alias("literal")).select("literal", "file").distinct()


def related(calls: DataFrame, ancestors: DataFrame, owner: str, target: str) -> DataFrame:
    """Rows whose two types are equal, unknown, or one an ancestor of the other."""
    a = ancestors.select(F.col("type").alias(owner), F.col("ancestor").alias(target), F.lit(True).alias("_up"))
    b = ancestors.select(F.col("type").alias(target), F.col("ancestor").alias(owner), F.lit(True).alias("_down"))
    known = calls.join(a, [owner, target], "left").join(b, [owner, target], "left")
    blank = (F.coalesce(owner, F.lit("")) == "") | (F.coalesce(target, F.lit("")) == "")
    return known.where(blank | (F.col(owner) == F.col(target)) | F.col("_up") | F.col("_down")).drop("_up", "_down")


# Families of C++ types that convert into each other.
NUMERIC = ["short", "int", "long", "float", "double", "size_t"]
STRINGS = ["string-literal", "char", "string", "string_view"]
FIRST = 4


def types_fit(arguments: Column, parameters: Column) -> Column:
    """Argument types against parameter types: unknown or template-like ones and other lengths pass; families convert."""
    one = lambda a, p: (
        (F.coalesce(a, F.lit("")) == "")
        | (F.coalesce(p, F.lit("")) == "")
        | (a == p)
        | p.rlike(r"^[A-Z]\w*$")
        | (a.isin(NUMERIC) & p.isin(NUMERIC))
        | (a.isin(STRINGS) & p.isin(STRINGS))
    )
    # the first FIRST places without a function of arrays, which no code is generated for
    fits = F.size(arguments) != F.size(parameters)
    each = functools.reduce(operator.and_, [(F.size(arguments) <= i) | one(F.get(arguments, F.lit(i)), F.get(parameters, F.lit(i))) for i in range(FIRST)])
    return fits | (each & ((F.size(arguments) <= FIRST) | F.forall(F.zip_with(arguments, parameters, one), lambda x: x)))


def supertypes(declared: DataFrame, overwrite: bool = False) -> DataFrame:
    """type, parent from declarations (type, parents, decl_seq): all of them, or only the last declaration's."""
    if overwrite:
        declared = declared.groupBy("type").agg(F.max_by("parents", "decl_seq").alias("parents"))
    return declared.select("type", F.explode("parents").alias("parent")).distinct()


def visibility(members: DataFrame) -> DataFrame:
    """Members of a class body with the visibility that the last marker before them set (public at first)."""
    out = last_value(members, ["class"], [F.col("pos")], "marker", "visibility")
    return out.withColumn("visibility", F.coalesce("visibility", F.lit("public")))


def attach_pending(items: DataFrame) -> DataFrame:
    """Members of a body with the marks right before them.  items: body, pos, kind (mark, method or other), name; marks hold for the
    next item only, if that is a method.  Gaps and islands: marks between two items share the number of items before them."""
    each = ranked(items.withColumn("item", (F.col("kind") != "mark").cast("int")), ["body"], [F.col("pos")], "place", {"items": "item"})
    each = each.withColumn("island", F.col("items") - F.col("item"))
    marks = each.where("kind = 'mark'").groupBy("body", "island").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("marks"))
    out = each.where("kind <> 'mark'").join(marks, ["body", "island"], "left")
    return out.select("body", "pos", "kind", "name", F.when(F.col("kind") == "method", F.coalesce("marks", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("marks"))


def route_prefixes(blocks: DataFrame, rounds: int = 10) -> DataFrame:
    """block, route: the segments of a block and of all blocks around it, outermost first.  blocks: block, parent (null at the top), segment.
    Prefixes double their reach each round, so a nesting of depth d takes log2(d) joins; what
    is nested in a circle, or beyond 2 ** rounds, is an error."""
    now = cut(blocks.select("block", "parent", F.coalesce("segment", F.lit("")).alias("route")))
    for _ in range(rounds):
        if now.where("parent IS NOT NULL").isEmpty():
            return now.select("block", "route")
        up = now.select(F.col("block").alias("parent"), F.col("parent").alias("above"), F.col("route").alias("before"))
        now = cut(now.join(up, "parent", "left").select("block", F.col("above").alias("parent"), F.concat(F.coalesce("before", F.lit("")), "route").alias("route")))
    raise RuntimeError("blocks are nested in a circle or too deep")


def with_synthetic(methods: DataFrame, entries: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Methods with one for each entry block (file, name, start, end, reason) that is none yet, and calls with the blocks as their callers.

    A block whose file, name and span a method has already makes that method an entry; any other becomes a method of its own (method_seq:
    minus a hash of it).  Calls of a file within a new method's lines are its calls from then on, of nested ones the innermost's."""
    at = ["file", "name", "start", "end"]
    blocks = entries.groupBy(*at).agg(F.min("reason").alias("reason"))
    known = methods.join(blocks, at, "left").withColumn("entry_reason", F.coalesce("reason", "entry_reason")).withColumn("definitive", F.col("definitive") | F.col("reason").isNotNull()).select(*methods.columns)
    seq = -F.pmod(F.xxhash64(*at), F.lit(1 << 62)) - 1
    new = blocks.join(methods.select(*at), at, "left_anti").select(*at, F.col("reason").alias("entry_reason"), F.lit(True).alias("definitive"), seq.alias("method_seq"))
    places = calls.select("file", "line").distinct()
    inside = enclosing(places.select(F.struct("file", "line").alias("point"), "file", "line"), new.select("file", "start", "end", F.col("method_seq").alias("name"), F.col("method_seq").alias("seq")))
    moved = calls.join(inside.select("file", "line", F.col("name").alias("_to")), ["file", "line"], "left")
    return known.unionByName(new, allowMissingColumns=True), moved.withColumn("caller_seq", F.coalesce("_to", "caller_seq")).select(*calls.columns)


def only_form(rows: DataFrame, keys: list[str], form: str) -> DataFrame:
    """The value that all rows of a key have in a column, null if they differ or some have none."""
    same = (F.min(form) == F.max(form)) & (F.count(form) == F.count("*"))
    return rows.groupBy(*keys).agg(F.when(same, F.max(form)).alias(form))


def visible_macros(includes: DataFrame, macros: DataFrame) -> DataFrame:
    """file, name: macros of a file and of all files it includes, however indirectly.  includes: file, included; macros: file, name.

    Names are handed on from a header to what includes it, and a name stops where it was seen before: the work follows the answer's rows, not
    the pairs of files that reach each other."""
    # a null is handed on like any other name, and a null file keeps its own names, though no include leads there; files are their own homes
    told = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    plain = lambda c: F.when(F.col(c) != "", F.substring(c, 2, 1 << 30))
    deal = lambda df: df.withColumn("home", F.col("node")).repartition("home")
    with joined_in_place(macros.sparkSession):
        edges = includes.where("included <> file").select(told("included").alias("node"), told("file").alias("dst"))
        edges = cut(deal(edges).distinct(), "edges", ["home"], lies=True)
        found = spread(macros.select(told("file").alias("node"), told("name").alias("form")), edges, deal=deal)
    return found.select(plain("node").alias("file"), plain("form").alias("name"))


def callback_calls(calls: DataFrame, methods: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls of a parameter's name, as calls of what callers hand in at that place: caller_seq, call_seq, callee.
    calls: call_seq, caller_seq, callee, symbols; methods: method_seq, parameter_names; edges: call_seq, method_seq (who a call reaches)."""
    places = methods.select(F.col("method_seq").alias("caller_seq"), F.posexplode("parameter_names").alias("pos", "callee"))
    inner = calls.join(places.distinct(), ["caller_seq", "callee"]).select("caller_seq", "call_seq", "pos")
    named = calls.select("call_seq", F.posexplode("symbols").alias("pos", "symbol")).where("symbol <> ''")
    # each symbol once for a place, before calls of that place meet it
    handed = edges.join(named, "call_seq").select(F.col("method_seq").alias("caller_seq"), "pos", "symbol").distinct()
    return inner.join(handed, ["caller_seq", "pos"]).select("caller_seq", "call_seq", F.col("symbol").alias("callee")).distinct()


def reflective_files(names: DataFrame, literals: DataFrame, shown: int = 2) -> DataFrame:
    """name, files, more: files with a string literal of a method's name, the first ones and how many follow."""
    each = literals.select(F.col("literal").alias("name"), "file").distinct()
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("file"))).where(F.col("_n") <= shown)  # a top-n of each task's own, then of those
    some = first.groupBy("name").agg(F.array_sort(F.collect_list("file")).alias("some"))
    count = each.groupBy("name").agg(F.count("file").alias("n"))
    met = names.join(count, "name", "left").join(some, "name", "left")
    return met.select("name", F.coalesce(F.array_join("some", ","), F.lit("")).alias("files"), F.greatest(F.coalesce("n", F.lit(0)).cast("int") - shown, F.lit(0)).alias("more"))


def implicit_members(calls: DataFrame, signatures: DataFrame) -> DataFrame:
    """Calls with target_owner set to the caller's owner where that owner has the called name and arity."""
    own = signatures.select("owner", F.col("name").alias("callee"), "arity").distinct().withColumn("_own", F.lit(True))
    return calls.join(own, ["owner", "callee", "arity"], "left").withColumn("target_owner", F.when(F.col("_own"), F.col("owner")).otherwise(F.col("target_owner"))).drop("_own")


def delete_cascade(tables: list[tuple[DataFrame, list[str], list[str]]], gone: DataFrame) -> list[DataFrame]:
    """What is left of each table once the rows of the first whose key is in gone are deleted, with all that refers to them, directly or not.

    tables: (rows, key columns, columns that refer to the key of the table before; none for the first), parents first.  Keys that go are
    handed down a level at a time, each level met by its foreign key, so a parent with a third of all children is one row of that join's
    small side.  A null reference belongs to nobody and stays, as does a child of a parent that was never there; a null key is never referred to."""
    left = []
    for i, (rows, key, refers) in enumerate(tables):
        on = key if i == 0 else refers
        names = [f"_g{k}" for k in range(len(on))]
        dead = gone.select(*[F.col(c).alias(n) for c, n in zip(gone.columns, names, strict=True)]).distinct()
        same = functools.reduce(operator.and_, [F.col(c) == F.col(n) for c, n in zip(on, names, strict=True)])
        left.append(rows.join(dead, same, "left_anti"))
        gone = rows.join(dead, same, "left_semi").select(*key).dropna()
    return left
