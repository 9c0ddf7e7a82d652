"""Allocation forms, include resolution and framework references against plain versions and on awkward rows."""

import posixpath
import random

from pyspark.sql import functions as F

from riskloom.operators import forms as M
from riskloom.operators import includes as I
from riskloom.operators import references as R

KINDS = {
    "news": "function string, symbol string, form string", "copies": "function string, dst_symbol string, src_symbol string", "results": "function string, symbol string, called string",
    "returns": "function string, form string, symbol string, called string", "params": "function string, place int, symbol string", "args": "function string, called string, place int, form string, symbol string", "files": "function string, file string",
}


def plain_forms(news=(), copies=(), results=(), returns=(), params=(), args=(), files=()):
    """{(function, symbol) or (function,): form} in three steps, each a closure over sets."""
    file = dict(files)

    def close(facts, edges, shut=()):
        have = {n: set(f) for n, f in facts.items()}
        while True:
            new = [(b, f) for a, b in edges if b not in shut for f in have.get(a, ()) if f not in have.get(b, ())]
            if not new:
                return have
            for b, f in new:
                have.setdefault(b, set()).add(f)

    def settle(have):
        return {n: next(iter(f)) if len(f) == 1 else "conflict" for n, f in have.items()}

    facts = {}
    for fn, s, form in news:
        facts.setdefault((fn, s), set()).add(form)
    for fn, form, _, _ in returns:
        if form:
            facts.setdefault((fn,), set()).add(form)
    within = [((f, a), (f, b)) for f, a, b in copies] + [((f, b), (f, a)) for f, a, b in copies] + [((g,), (f, s)) for f, s, g in results]
    within += [((f, s), (f,)) for f, _, s, _ in returns if s] + [((g,), (f,)) for f, _, _, g in returns if g]
    one = settle(close(facts, within))
    names = {(f, s) for f, s, _ in news} | {(f, x) for f, a, b in copies for x in (a, b)} | {(f, s) for f, s, _ in results} | {(f, s) for f, _, s, _ in returns if s} | {(f, s) for f, _, s in params} | {(f, s) for f, _, _, _, s in args if s}
    seeds = {}
    for f, s in names:
        for g, t, form in news:
            if s == t and f in file and file.get(g) == file[f] and (f, s) not in one:
                seeds.setdefault((f, s), set()).add(form)
    two = one | settle(close(seeds, within, one))
    seeds, ways = {}, list(within)
    for caller, g, place, form, s in args:
        for h, q, param in params:
            if h == g and q == place and (h, param) not in two:
                if form:
                    seeds.setdefault((h, param), set()).add(form)
                if s:
                    ways.append(((caller, s), (h, param)))
                    got = two.get((caller, s))
                    if got:
                        seeds.setdefault((h, param), set()).update(("array", "scalar") if got == "conflict" else (got,))
    return two | settle(close(seeds, ways, two))


def forms(spark, **given):
    tables = {k: spark.createDataFrame(list(given.get(k, [])), kind) for k, kind in KINDS.items()}
    out = {}
    for r in M.allocation_form(**tables).collect():
        kind, _, name = r.node.partition("|")
        key = tuple(name.split("|")) if kind == "v" else (name,)
        assert key not in out
        out[key] = r.form
    return out


def test_forms_against_plain(spark):
    r = random.Random(8)
    fn, sym, form = (lambda: f"f{r.randrange(14)}"), (lambda: f"s{r.randrange(5)}"), (lambda: r.choice(["array", "scalar"]))
    given = {
        "news": [(fn(), sym(), form()) for _ in range(9)], "copies": [(fn(), sym(), sym()) for _ in range(35)], "results": [(fn(), sym(), fn()) for _ in range(8)], "params": [(f"f{i}", p, f"s{p}") for i in range(14) for p in (0, 1)],
        "returns": [(f"f{i}", *r.choice([(None, sym(), None), (None, None, fn()), (form(), None, None)])) for i in range(0, 14, 2)], "args": [(fn(), fn(), r.randrange(2), *r.choice([(form(), None), (None, sym())])) for _ in range(14)], "files": [(f"f{i}", f"x{i // 4}") for i in range(13)],
    }
    got = forms(spark, **given)
    assert got == plain_forms(**given) and {"array", "scalar", "conflict"} <= set(got.values())


def test_forms_far_and_by_precedence(spark):
    chain = [("a", f"s{i + 1}", f"s{i}") for i in range(20)]
    given = {
        "news": [("a", "s0", "array"), ("k", "this.m", "scalar"), ("loc", "p", "array"), ("two", "x", "array"), ("two", "x", "scalar")],
        "copies": [*chain, ("a", "s0", "s20"), ("self", "z", "z"), ("b", "q", "r")],
        "returns": [("mk", "scalar", None, None), ("mk2", None, None, "mk"), ("mk3", None, None, "mk2"), ("both", "scalar", None, None), ("both", "array", None, None)],
        "results": [("b", "q", "mk3"), ("c", "y", "both"), ("dtor", "t", "nothing")],
        "params": [("loc", 0, "p"), ("cal", 0, "p"), ("deep", 0, "p"), ("cal", 1, "w"), ("dtor", 0, "this.m")],
        "args": [("a", "loc", 0, "scalar", None), ("a", "cal", 0, None, "s20"), ("z", "cal", 0, "array", None), ("cal", "deep", 0, None, "p"), ("two", "cal", 1, None, "x"), ("z", "dtor", 0, "array", None), ("z", "missing", 0, "array", None)],
        "files": [("k", "one.cpp"), ("dtor", "one.cpp"), ("loc", "l.cpp")],
    }
    got = forms(spark, **given)
    assert got == plain_forms(**given)
    assert got["a", "s20"] == "array" and got["b", "r"] == "scalar" and got["c", "y"] == "conflict" and got["dtor", "this.m"] == "scalar"
    assert got["loc", "p"] == "array" and got["deep", "p"] == "array" and got["cal", "w"] == "conflict" and ("self", "z") not in got and ("dtor", "t") not in got
    uses = spark.createDataFrame([(1, "a", "s20", "scalar"), (2, "a", "s20", "array"), (3, "self", "z", "array"), (4, "c", "y", "array"), (5, None, "z", "array")], "form long, function string, symbol string, released string")
    tables = {k: spark.createDataFrame(given.get(k, []), kind) for k, kind in KINDS.items()}
    rows = M.release_mismatch(uses.withColumnRenamed("form", "use_id"), M.allocation_form(**tables)).collect()
    assert sorted((x.use_id, x.form, x.confirmed) for x in rows) == [(1, "array", True), (2, "array", False), (3, "unknown", False), (4, "conflict", False), (5, "unknown", False)]
    assert forms(spark) == {}


def moved(spark, after=-1):
    """Rows written to shuffles by stages beyond ``after``, and the last stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in stages if s.stageId() > after), max((s.stageId() for s in stages), default=-1)


def test_forms_move_statements_once(spark):
    """However far facts go along copies, a copy moves once and its variables once more."""
    copies = [(f"f{i}", f"s{j + 1:02}", f"s{j:02}") for i in range(40) for j in range(30)] + [("f0", "z", "z"), ("f0", "y", None), ("f0", None, None), (None, "s00", "z")]
    given = {"copies": copies, "news": [(f"f{i}", "s00", "array") for i in range(40)] + [("k", "z", "scalar"), ("k", "y", "array")], "files": [("f0", "a.cpp"), ("k", "a.cpp")]}
    _, last = moved(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = forms(spark, **given)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    n, _ = moved(spark, last)
    assert got == {k: v for k, v in plain_forms(**given).items() if None not in k} and len(got) == 40 * 31 + 4 and got["f0", "z"] == "scalar" and got["f0", "y"] == "array"
    assert n < 3 * len(copies)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_classes_and_tables_dealt_alike(spark):
    r = random.Random(3)
    pairs = {tuple(sorted((f"v|f{h}|{r.randrange(40):02}", f"v|f{h}|{r.randrange(40):02}"))) for h in range(5) for _ in range(30)} | {("v|operator||a", "v|operator||b")}
    pairs = [(a, b) for a, b in pairs if a != b]
    one = {x: x for p in pairs for x in p}
    for _ in pairs:
        for a, b in pairs:
            one[a] = one[b] = min(one[a], one[b])
    df = M.dealt(spark.createDataFrame(pairs, "a string, b string"), "a")
    assert sorted((x.node, x.one) for x in M.classes(df).collect()) == sorted(one.items())
    rows = [[(f"r|f{i}", form) for i in range(14)] for form in ("array", "scalar")]
    tables = [M.cut(M.dealt(spark.createDataFrame(x, "node string, form string")), "facts", ["home"], lies=True) for x in rows]
    assert sorted((x.node, x.form) for x in M.settled(tables[0].unionAll(tables[1])).collect()) == sorted((n, "conflict") for n, _ in rows[0])


def test_include_edges_against_plain(spark):
    r = random.Random(2)
    files = ["main.cpp", "a/x.h", "a/b/x.h", "a/b/y.h", "b/x.h", "x.h", "c d/é.h"]
    parts = ["..", ".", "a", "b", "x.h", "y.h", "", "main.cpp", "c d", "é.h"]
    includes = [(r.choice([*files, "lost/z.cpp"]), "/".join(r.choice(parts) for _ in range(r.randrange(1, 6)))) for _ in range(500)] + [("a/x.h", "x.h"), ("a/b/y.h", "/a/x.h"), ("a/b/y.h", "../../../x.h")]
    includes = [(f, i) for f, i in includes if i] + [(None, "x.h"), ("main.cpp", None)]

    def plain(file, included):
        if file is None or included is None or included.startswith("/"):
            return None, "none"
        for how, path in (("own", posixpath.join(posixpath.dirname(file), included)), ("root", included)):
            if posixpath.normpath(path) in files:
                return posixpath.normpath(path), how
        return None, "none"

    df = spark.createDataFrame(includes, "file string, included string")
    got = sorted(map(str, ((x.file, x.included, x.target, x.found) for x in I.include_edges(df, spark.createDataFrame([(f,) for f in files * 2], "file string")).collect())))
    assert got == sorted(str((f, i, *plain(f, i))) for f, i in includes)
    assert I.include_edges(df.limit(0), spark.createDataFrame([], "file string")).count() == 0


def test_included_macros_in_circles(spark):
    lines = spark.createDataFrame([("a.h", 1, '#include "b.h"'), ("b.h", 1, ' # include  "sub/c.h" // x'), ("sub/c.h", 2, '#include "../a.h"'), ("sub/c.h", 3, "#include <b.h>"), ("d.h", 1, '#include "gone.h"'), ("e.h", 9, '#include "e.h"')], "file string, line_no int, line string")
    files = spark.createDataFrame([(f,) for f in ("a.h", "b.h", "sub/c.h", "d.h", "e.h")], "file string")
    macros = spark.createDataFrame([("a.h", "A"), ("sub/c.h", "C"), ("d.h", "D"), ("e.h", "E"), ("gone.h", "G")], "file string, name string")
    got = {(x.file, x.name) for x in I.included_macros(I.includes_of(lines).select("file", "included"), files, macros).collect()}
    assert got == {(f, n) for f in ("a.h", "b.h", "sub/c.h") for n in "AC"} | {("d.h", "D"), ("e.h", "E"), ("gone.h", "G")}


def test_included_macros_of_odd_files(spark):
    """Macros go through files whose names hold the sign that parts other nodes, and a null file keeps its own."""
    files = ["a|b.h", "a|c.h", "|", *[f"d{i}.h" for i in range(40)]]
    includes = [("a|b.h", "a|c.h"), ("a|c.h", "|"), ("|", "a|b.h")] + [(f"d{i}.h", "a|b.h") for i in range(40)]
    macros = [("|", f"M|{i}") for i in range(5)] + [("d3.h", "M|0"), (None, "N"), ("d4.h", None)]
    df = I.included_macros(spark.createDataFrame(includes, "file string, included string"), spark.createDataFrame([(f,) for f in files], "file string"), spark.createDataFrame(macros, "file string, name string"))
    got = sorted(((x.file, x.name) for x in df.collect()), key=str)
    assert got == sorted([(f, f"M|{i}") for f in files for i in range(5)] + [(None, "N"), ("d4.h", None)], key=str)


def test_last_reference_wins_in_one_language(spark):
    methods = spark.createDataFrame([(1, "f", "N::A", "cpp", None, False), (2, "f", "B", "cpp", "old", True), (3, "f", "", "cpp", None, False), (4, "f", "A", "java", None, False), (5, "g", None, "cpp", "kept", False)], "method_seq long, name string, owner string, language string, entry_reason string, definitive boolean")
    refs = spark.createDataFrame([(1, "f", "A", "r1"), (5, "f", "x::A", "r5"), (3, "f", "", "r3"), (2, "f", None, "r2"), (9, "h", "", "r9"), (4, "f", "Z", "r4")], "ref_seq long, name string, owner string, reason string")
    got = {x.method_seq: (x.entry_reason, x.definitive) for x in R.apply_last(methods, refs).collect()}
    assert got == {1: ("r5", True), 2: ("r3", True), 3: ("r3", True), 4: (None, False), 5: ("kept", False)}
    assert R.apply_last(methods, refs.limit(0)).where(F.col("entry_reason").isNotNull()).count() == 2
