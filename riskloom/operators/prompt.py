"""Prompt context: what a verifier is shown about each candidate, put together from a table of source lines within fixed budgets.

A context is a list of pieces (sink, at, text | file, lo, hi): words, and spans of lines that are wanted.  Spans of all candidates are
gathered and made distinct, lines are fetched once for them from blocks of ``BLOCK`` lines (an interval join on block numbers, never
on a file alone), and pieces are folded in the order of ``at``.  A candidate has a bounded number of pieces: two windows, ``CHAINS``
chains of at most max_depth hops with the code of the first, and ``BODIES`` callees; what is left out is counted.

Edge cases: a file that is not there, or a line that is null, is said to be missing; windows end where the file ends; an empty file gives an
empty window; a candidate outside all methods gets the lines around it and the note that says so.  Repeated candidates with one sink number
are one.  Names are compared as they are.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut
from .context import HEAD, WHOLE, WINDOW, hop_budget
from .discovery import chains
from .graph import enclosing
from .notes import unreachable_notes

# Chains and lines around an entry that are shown, lines below a hop's call, callees and their lines.
CHAINS, ENTRY_WINDOW, BELOW, BODIES, BODY_LINES = 4, 8, 2, 3, 40
#: How many callers a context's note looks at, at the utmost.
SEEN = 200
BLOCK = 64
BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
PREDICATES = ["boolean", "Boolean"]
PIECE = "struct<at:array<int>,text:string,file:string,lo:int,hi:int>"


def blocks(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """file, block, first, lines: the lines of each file (file, text), size at a time; a break at the end of a text begins no line."""
    text = F.regexp_replace("text", rf"(?:{BREAK})\z", "")
    lines = F.when(F.col("text") != "", F.split(text, BREAK, -1)).otherwise(F.array().cast("array<string>"))
    cut_ = files.select("file", lines.alias("all")).where("size(all) > 0").select("file", "all", F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / size).cast("int"))).alias("block"))
    return cut_.select("file", "block", (F.col("block") * size + 1).alias("first"), F.slice("all", F.col("block") * size + 1, F.lit(size)).alias("lines"))


def fetch(spans: DataFrame, lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """file, lo, hi, shown: the numbered lines of each span (file, lo, hi); spans are taken once, however often they are wanted."""
    wanted = spans.select("file", "lo", "hi").distinct().where("hi >= 1 AND hi >= lo")
    dealt = wanted.withColumn("block", F.explode(F.sequence(F.floor((F.greatest("lo", F.lit(1)) - 1) / size).cast("int"), F.floor((F.col("hi") - 1) / size).cast("int"))))
    met = dealt.join(lines, ["file", "block"])
    low, high = F.greatest("lo", "first"), F.least(F.col("hi"), F.col("first") + F.size("lines") - 1)
    numbered = F.transform(F.sequence(low, high), lambda i: F.concat(F.repeat(F.lit(" "), F.greatest(5 - F.length(i.cast("string")), F.lit(0))), i.cast("string"), F.lit(" | "), F.element_at("lines", (i - F.col("first") + 1).cast("int"))))
    some = met.where(low <= high).select("file", "lo", "hi", "block", F.array_join(numbered, "\n").alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "part")))
    return some.groupBy("file", "lo", "hi").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n").alias("shown"))


def fold(pieces: DataFrame, shown: DataFrame) -> DataFrame:
    """sink, context: the pieces of each sink in order, spans replaced by their lines."""
    text = F.coalesce("text", "shown", F.lit(""))
    rows = pieces.join(shown, ["file", "lo", "hi"], "left").select("sink", "at", text.alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "t")))
    return rows.groupBy("sink").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("context"))


def _at(*places) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, int) else p.cast("int") for p in places])


def _say(at: Column, text: Column) -> Column:
    return F.struct(at.alias("at"), text.alias("text"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))


def _show(at: Column, file: Column, lo: Column, hi: Column) -> Column:
    return F.struct(at.alias("at"), F.lit(None).cast("string").alias("text"), file.alias("file"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _pieces(df: DataFrame, *each: Column) -> DataFrame:
    """sink and the pieces of each row that are not null."""
    return df.select("sink", F.inline(F.filter(F.array(*[e.cast(PIECE) for e in each]), lambda x: x.isNotNull())))


def window_pieces(places: DataFrame, block: int) -> DataFrame:
    """Pieces for places (sink, file, line, start, end, there): the method around the line, or the lines around it; of a long method its
    head and the lines around."""
    file, line, start, end = F.col("file"), F.col("line"), F.col("start"), F.col("end")
    missing = ~F.coalesce("there", F.lit(False)) | line.isNull()
    plain, long = start.isNull(), end - start + 1 > WHOLE
    head = start + HEAD - 1
    low, high = F.greatest(line - WINDOW, head + 1), F.least(line + WINDOW, end)
    tail = ~missing & ~plain & long & (low <= high)
    return _pieces(
        places,
        F.when(missing, _say(_at(block, 1), F.concat(F.lit("(no such file: "), F.coalesce(file, F.lit("")), F.lit(")")))),
        F.when(~missing, _show(_at(block, 1), file, F.when(plain, line - WINDOW).otherwise(start), F.when(plain, line + WINDOW).when(long, head).otherwise(end))),
        F.when(tail, _say(_at(block, 2), F.concat(F.lit("\n      | ... "), (low - head - 1).cast("string"), F.lit(" lines omitted ...\n")))),
        F.when(tail, _show(_at(block, 3), file, low, high)),
    )


def chain_pieces(found: DataFrame, calls: DataFrame, methods: DataFrame, there: DataFrame) -> DataFrame:
    """Pieces for the first CHAINS chains of each sink (sink, place, depth, chain) that are longer than none, and how many more there are."""
    count = found.groupBy("sink").agg(F.count("*").alias("n"))
    first = cut(found.where(F.col("place") <= CHAINS), "chains")
    caller = methods.select(F.col("method_seq").alias("caller_seq"), "name", "start", "end", "entry_reason", F.col("file").alias("m_file"), F.col("start").alias("m_start"))
    hop = first.select("sink", "place", "depth", F.posexplode("chain").alias("hop", "call_seq")).join(calls.select("call_seq", "caller_seq", "file", "line"), "call_seq").join(caller, "caller_seq").join(there, "file", "left")
    hop = cut(hop, "hops")
    hops = F.array_sort(F.collect_list(F.struct("hop", F.concat("name", F.lit("() at "), "file", F.lit(":"), F.col("line").cast("string")).alias("t"))))
    last = F.col("hop") == F.col("depth") - 1
    pick = lambda c: F.max(F.when(last, F.col(c))).alias(c)
    path = hop.groupBy("sink", "place").agg(F.array_join(F.transform(hops, lambda x: x["t"]), " <- ").alias("hops"), *[pick(c) for c in ("name", "m_file", "m_start", "entry_reason", "there")])
    at = lambda *x: _at(20, F.col("place"), *x)
    lost = ~F.coalesce("there", F.lit(False))
    said = _pieces(
        path,
        _say(at(1), F.concat(F.when(F.col("place") == 1, "\n\n## Calls from entries\n").otherwise("\n"), "hops", F.lit("\nEntry: "), "name", F.lit("() in "), "m_file", F.lit(", "), "entry_reason", F.lit("\n"))),
        F.when(lost, _say(at(2), F.concat(F.lit("(no such file: "), "m_file", F.lit(")")))).otherwise(_show(at(2), F.col("m_file"), F.col("m_start") - ENTRY_WINDOW, F.col("m_start") + ENTRY_WINDOW)),
        _say(at(9), F.lit("\n")),
    )
    # the code of the first chain, the entry's first
    room = hop_budget(F.col("depth"))
    whole = F.col("end") - F.col("start") + 1 <= room
    lo, hi = F.greatest(F.col("start") + 1, F.col("line") - (room - 1 - BELOW)), F.least(F.col("end"), F.col("line") + BELOW)
    step = F.col("depth") - F.col("hop")
    code = _pieces(
        hop.where("place = 1 AND depth > 1 AND there"),
        _say(at(3, step, 1), F.concat(F.lit("\n\n-- "), "name", F.lit("() in "), "file", F.lit(", calls on at line "), F.col("line").cast("string"), F.lit("\n"))),
        _show(at(3, step, 2), F.col("file"), F.col("start"), F.when(whole, F.col("end")).otherwise(F.col("start"))),
        F.when(~whole, _say(at(3, step, 3), F.when(lo > F.col("start") + 1, "\n      | ...\n").otherwise("\n"))),
        F.when(~whole, _show(at(3, step, 4), F.col("file"), lo, hi)),
    )
    more = _pieces(count.where(F.col("n") > CHAINS), _say(_at(20, CHAINS + 1), F.concat(F.lit("\n(+"), (F.col("n") - CHAINS).cast("string"), F.lit(" more call paths)\n"))))
    return said.unionAll(code).unionAll(more)


def callees(sinks: DataFrame, calls: DataFrame, methods: DataFrame) -> DataFrame:
    """sink, method_seq, rank, n: the methods that a sink's method calls up to the sink (sink, line, method_seq), nearest call first, each
    once; a call counts if one method fits its name and arity, or one of the sink's own file.  Predicates and the method itself don't."""
    held = methods.select(F.col("method_seq").alias("own_seq"), F.col("file").alias("own_file"))
    sites = sinks.where("method_seq IS NOT NULL").select("sink", F.col("line").alias("sink_line"), F.col("method_seq").alias("own_seq")).join(held, "own_seq")
    made = sites.join(calls.select(F.col("caller_seq").alias("own_seq"), "call_seq", "callee", "arity", "line"), "own_seq").where("line <= sink_line")
    # methods of one name and arity are counted before calls meet them: a common name is one row
    fits = methods.select(F.col("name").alias("callee"), "arity", "file", "method_seq")
    named = fits.groupBy("callee", "arity").agg(F.count("*").alias("n_all"), F.min("method_seq").alias("only"))
    own = fits.groupBy("callee", "arity", F.col("file").alias("own_file")).agg(F.count("*").alias("n_own"), F.min("method_seq").alias("only_own"))
    one = made.join(named, ["callee", "arity"]).join(own, ["callee", "arity", "own_file"], "left")
    one = one.withColumn("to", F.when(F.col("n_all") == 1, F.col("only")).when(F.col("n_own") == 1, F.col("only_own"))).where("to IS NOT NULL AND to <> own_seq")
    near = one.groupBy("sink", F.col("to").alias("method_seq")).agg(F.min(F.struct((F.col("sink_line") - F.col("line")).alias("far"), "call_seq")).alias("at"))
    near = near.join(methods.select("method_seq", "return_type"), "method_seq").where(~F.coalesce(F.col("return_type").isin(PREDICATES), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("sink").orderBy("at"))
    return near.select("sink", "method_seq", rank.alias("rank"), F.count("*").over(Window.partitionBy("sink")).alias("n"))


def callee_pieces(found: DataFrame, methods: DataFrame, there: DataFrame) -> DataFrame:
    """Pieces for the first BODIES callees (sink, method_seq, rank, n), and how many more there are."""
    rows = found.where(F.col("rank") <= BODIES).join(methods.select("method_seq", "file", "name", "start", "end"), "method_seq").join(there, "file", "left")
    at = lambda i: _at(30, F.col("rank"), i)
    stop = F.least(F.col("end"), F.col("start") + BODY_LINES - 1)
    lost, left = ~F.coalesce("there", F.lit(False)), F.col("end") - stop
    return _pieces(
        rows,
        _say(at(1), F.concat(F.when(F.col("rank") == 1, "\n\n## Called on the way\n").otherwise("\n"), F.lit("\n"), "name", F.lit("() in "), "file", F.lit("\n"))),
        F.when(lost, _say(at(2), F.lit("(no such file)"))).otherwise(_show(at(2), F.col("file"), F.col("start"), stop)),
        F.when(left > 0, _say(at(3), F.concat(F.lit("\n      | ... "), left.cast("string"), F.lit(" more lines ...")))),
        F.when((F.col("rank") == 1) & (F.col("n") > BODIES), _say(_at(30, BODIES + 1), F.concat(F.lit("\n\n(+"), (F.col("n") - BODIES).cast("string"), F.lit(" more called methods)")))),
    )


def by_kin(sinks: DataFrame, methods: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sinks, methods and edges with owner, name and arity as their node: a module that is there twice is no caller of itself."""
    kin = methods.withColumn("kin", F.concat_ws("|", "owner", "name", F.col("arity").cast("string")))
    of = kin.select("node", "kin").distinct()
    facts = kin.groupBy(F.col("kin").alias("node")).agg(F.min_by(F.struct("file", "owner", "name", "supertypes", "anonymous", "overrides"), "method_seq").alias("_m")).select("node", "_m.*")
    side = lambda old, new: of.select(F.col("node").alias(old), F.col("kin").alias(new))
    among = edges.join(side("caller", "_from"), "caller").join(side("callee", "_to"), "callee").select(F.col("_from").alias("caller"), F.col("_to").alias("callee"), "seq")
    return sinks.join(of, "node", "left").select("sink", F.col("kin").alias("node")), facts, among


def prompt_context(candidates: DataFrame, files: DataFrame, methods: DataFrame, calls: DataFrame, edges: DataFrame, literals: DataFrame, max_depth: int = 20) -> DataFrame:
    """sink, context for candidates (sink, source_file, source_line, sink_file, sink_line).

    files: file, text; methods: method_seq, node, file, start, end, owner, name, arity, return_type, entry_reason, definitive, supertypes,
    anonymous, overrides; calls: call_seq, caller_seq, file, line, callee, arity; edges: caller, callee (nodes), seq; literals: literal, file."""
    given = ["source_file", "source_line", "sink_file", "sink_line"]
    candidates = cut(candidates.groupBy("sink").agg(F.min(F.struct(*given)).alias("_one")).select("sink", "_one.*"), "candidates")
    lines = cut(blocks(files), "lines")
    there = cut(files.select("file").distinct().withColumn("there", F.lit(True)), "files")
    spans = methods.select("file", "start", "end", F.col("method_seq").alias("name"), F.col("method_seq").alias("seq"))
    sides = candidates.select(F.concat(F.lit("k"), F.col("sink").cast("string")).alias("point"), "sink", F.lit("sink").alias("side"), F.col("sink_file").alias("file"), F.col("sink_line").alias("line"))
    sides = sides.unionAll(candidates.where("NOT (source_file <=> sink_file AND source_line <=> sink_line)").select(F.concat(F.lit("s"), F.col("sink").cast("string")), "sink", F.lit("source"), "source_file", "source_line"))
    placed = cut(enclosing(sides, spans).withColumnRenamed("name", "method_seq").join(there, "file", "left"), "places")
    both = candidates.select("sink", (F.col("source_file").eqNullSafe(F.col("sink_file")) & F.col("source_line").eqNullSafe(F.col("sink_line"))).alias("same"), "source_file", "sink_file")
    heads = _pieces(
        both,
        F.when(~F.col("same"), _say(_at(0), F.concat(F.lit("## Source: "), F.coalesce("source_file", F.lit("")), F.lit("\n")))),
        _say(_at(10), F.concat(F.when(F.col("same"), "## Source and sink: ").otherwise("\n\n## Sink: "), F.coalesce("sink_file", F.lit("")), F.lit("\n"))),
    )
    sinks = placed.where("side = 'sink'").join(methods.select("method_seq", "node"), "method_seq", "left")
    entries = methods.where("entry_reason IS NOT NULL").select("node", "definitive")
    found = cut(chains(sinks.where("node IS NOT NULL").select("sink", "node"), edges, entries, max_depth), "found")
    inside = _pieces(found.where("depth = 0"), _say(_at(20), F.lit("\n\n## Calls from entries\nThe sink is inside an entry.")))
    alone = sinks.join(found.select("sink").distinct(), "sink", "left_anti").select("sink", "node")
    notes = unreachable_notes(*by_kin(alone, methods, edges), literals, SEEN)
    why = _pieces(notes, _say(_at(20), F.concat(F.lit("\n\n## Calls from entries\n"), "note")))
    parts = [
        heads,
        window_pieces(placed.where("side = 'source'"), 1),
        window_pieces(placed.where("side = 'sink'"), 11),
        chain_pieces(found.where("depth > 0"), calls, methods, there),
        inside,
        why,
        callee_pieces(callees(sinks.select("sink", "line", "method_seq"), calls, methods), methods, there),
    ]
    pieces = cut(functools.reduce(DataFrame.unionAll, parts), "pieces")
    return fold(pieces, fetch(pieces.where("file IS NOT NULL"), lines))
