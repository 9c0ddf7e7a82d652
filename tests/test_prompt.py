"""Ordered search, notes and prompt contexts against plain versions and on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import discovery as D
from riskloom.operators import prompt as P
from riskloom.operators.notes import OUTCOMES, overriding, unreachable_notes


def search(start, edges, stop=(), depth=None, cap=None):
    """{node: (depth, chain, open)} by a plain breadth-first search in call order."""
    found, level = {start: (0, (), cap is None or cap > 1)}, [start]
    for d in range(1, 1000):
        if (depth is not None and d > depth) or (cap is not None and len(found) >= cap):
            break
        nxt = []
        for node in level:
            if d > 1 and node in stop:
                continue
            for seq, caller in sorted((s, a) for a, b, s in edges if b == node):
                if caller not in found:
                    found[caller] = (d, (*found[node][1], seq), True)
                    nxt.append(caller)
        if not nxt:
            break
        if cap is not None and len(found) >= cap:
            found |= {n: (*found[n][:2], False) for n in nxt}
        level = nxt
    return found


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}", s) for s in r.sample(range(1000), 130)]
    return edges, spark.createDataFrame(edges * 2, "caller string, callee string, seq long").cache()


def test_levels_against_plain(spark, graph):
    edges, df = graph
    starts = spark.createDataFrame([(i, f"n{i}") for i in range(12)] + [(0, "n0"), (99, "unknown")], "sink long, node string")
    stop = ["n1", "n2", "n20", "n30"]
    for kind in ({}, {"stop": stop}, {"depth": 3}, {"cap": 9}, {"cap": 1}):
        got = D.levels(starts, df, spark.createDataFrame([(n,) for n in stop], "node string") if "stop" in kind else None, kind.get("depth"), kind.get("cap"))
        have = {(r.sink, r.node): (r.depth, tuple(r.chain), r.open) for r in got.collect()}
        want = {(i, n): v for i, s in [*((i, f"n{i}") for i in range(12)), (99, "unknown")] for n, v in search(s, edges, **kind).items()}
        assert have == want, kind
    assert D.levels(starts.limit(0), df).count() == 0


def test_chains_and_ends_against_plain(spark, graph):
    edges, df = graph
    proven, hinted = {"n0", "n7", "n9"}, {"n1", "n33", "n41", "n50"}
    entries = spark.createDataFrame([(n, n in proven) for n in proven | hinted] + [("n0", False)], "node string, definitive boolean")
    starts = spark.createDataFrame([(i, f"n{i}") for i in range(60)], "sink long, node string")
    have = {}
    for r in D.chains(starts, df, entries).collect():
        have.setdefault(r.sink, []).append((r.place, r.entry, r.depth, tuple(r.chain)))
    for i in range(60):
        start = f"n{i}"
        if start in proven:
            want = [(start, 0, ())]
        else:
            found = search(start, edges, proven | hinted, 20)
            want = sorted(((n, d, c) for n, (d, c, _) in found.items() if d and n in proven | hinted), key=lambda x: x[1:])
            want = want or ([(start, 0, ())] if start in hinted else [])
        assert sorted(have.get(i, [])) == [(k, *w) for k, w in enumerate(want, 1)], start
    plain = [(a, b, s) for a, b, s in edges if a != b]
    got = {(r.start, r.leaf) for r in D.ends(starts.select(F.col("node").alias("start"), "node"), df, cap=8).collect()}
    called = {b for _, b, _ in plain}
    assert got == {(f"n{i}", n) for i in range(60) for n, (_, _, o) in search(f"n{i}", plain, cap=8).items() if o and n not in called}


METHODS = "node string, file string, owner string, name string, supertypes array<string>, anonymous boolean, overrides boolean"


def test_notes_by_precedence(spark):
    one = lambda n, **more: tuple(({"node": n, "file": f"{n}.x", "owner": n.upper(), "name": n, "supertypes": [], "anonymous": False, "overrides": False} | more).values())
    methods = [one("m1", name="main"), one("m2", name="main", overrides=True, supertypes=["Runnable"]), one("a"), one("b"), one("c"), one("o", overrides=True, supertypes=["Z", "B"]), one("x"), one("y"), one("anon", anonymous=True), one("over", overrides=True), one("lone", name="named"), one("bare", owner="", name="named")]
    methods += [one(f"e{i}") for i in range(6)] + [one(n) for n in ("many", "self", "mix")]
    edges = [("m1", "a", 1), ("m2", "a", 2), ("o", "b", 3), ("m1", "b", 4), ("x", "y", 5), ("y", "x", 6), ("x", "c", 7), ("self", "self", 8), ("m1", "mix", 9), ("e0", "mix", 10)]
    edges += [(f"e{i}", "many", 20 - i) for i in range(6)]
    literals = [("named", f"f{i}.x") for i in (3, 1, 2)] + [("o", "reg.x"), ("mix", "no.x")]
    sinks = [(i, n) for i, n in enumerate([None, "a", "b", "many", "c", "anon", "over", "lone", "bare", "self", "mix", None])]
    got = {r.sink: (r.outcome, r.note) for r in unreachable_notes(spark.createDataFrame(sinks, "sink long, node string"), spark.createDataFrame(methods, METHODS), spark.createDataFrame(edges, "caller string, callee string, seq long"), spark.createDataFrame(literals, "literal string, file string")).collect()}
    assert got == {
        0: ("no method", "No method is around this line."),
        1: ("startup", "Runs at startup only; all callers begin at M1.main() in m1.x, M2.main() in m2.x."),
        2: ("overrides", "No entry within reach; callers begin at O.o() in o.x; M1.main() in m1.x. Overridden types: B, Z. Named as text in reg.x."),
        3: ("ends", "No entry within reach; callers begin at E5.e5() in e5.x; E4.e4() in e4.x; E3.e3() in e3.x; E2.e2() in e2.x (+2 more)."),
        4: ("internal", "Only called by internal code that no entry reaches."),
        5: ("callback", "Nothing calls anon(); its type's users may, as a callback."),
        6: ("callback", "Nothing calls over(); its type's users may, as a callback."),
        7: ("unused", "Nothing calls named(); unused, or called by name. Named as text in f1.x, f2.x (+1 more)."),
        8: ("unused", "Nothing calls named(); unused, or called by name. Named as text in f1.x, f2.x (+1 more)."),
        9: ("unused", "Nothing calls self(); unused, or called by name."),
        10: ("ends", "No entry within reach; callers begin at M1.main() in m1.x; E0.e0() in e0.x."),
        11: ("no method", "No method is around this line."),
    }
    assert {o for o, _ in got.values()} == set(OUTCOMES)


def test_overrides_by_closure(spark):
    methods = spark.createDataFrame([(1, "A", "f", 1, None), (2, "B", "f", 1, False), (3, "C", "f", 1, False), (4, "C", "f", 2, False), (5, "C", "g", 1, True), (6, "", "f", 1, False), (7, "D", "f", 1, False)], "method_seq long, owner string, name string, arity int, marked boolean")
    up = spark.createDataFrame([("B", "A"), ("C", "B"), ("C", "A"), ("D", "Outside")], "type string, ancestor string")
    assert {r.method_seq for r in overriding(methods, up).collect() if r.overrides} == {2, 3, 5}


def test_lines_and_spans(spark):
    texts = {"a": "one\r\ntwo\rthree\n", "b": "", "c": "\n", "d": "x\n\n", "e": "\n".join(f"l{i}" for i in range(1, 301)), "n": None, "big": "\n" * 100_001}
    lines = P.blocks(spark.createDataFrame(list(texts.items()), "file string, text string"))
    want = {f: (t or "").splitlines() for f, t in texts.items()}
    spans = [("a", -3, 2), ("a", 2, 9), ("b", 1, 5), ("c", 1, 1), ("d", 1, 9), ("e", 60, 200), ("e", 299, 400), ("e", 301, 400), ("e", 5, 4), ("n", 1, 2), ("gone", 1, 2), ("big", 99_999, 100_001), ("a", 2, 9)]
    got = {(r.file, r.lo, r.hi): r.shown for r in P.fetch(spark.createDataFrame(spans, "file string, lo int, hi int"), lines).collect()}
    for f, lo, hi in set(spans):
        plain = "\n".join(f"{i:>5} | {want[f][i - 1]}" for i in range(max(1, lo), min(hi, len(want.get(f, []))) + 1))
        assert got.get((f, lo, hi), "") == plain, (f, lo, hi)


def test_contexts_of_awkward_candidates(spark):
    text = "\n".join(f"line {i}" for i in range(1, 401))
    files = spark.createDataFrame([("a", text), ("void", ""), ("h", text)], "file string, text string")
    m = lambda seq, node, file, start, end, name, **more: tuple(({"method_seq": seq, "node": node, "file": file, "start": start, "end": end, "owner": "O", "name": name, "arity": 0, "return_type": "int", "entry_reason": None, "definitive": False, "supertypes": [], "anonymous": False, "overrides": False} | more).values())
    kind = "method_seq long, node string, file string, start int, end int, owner string, name string, arity int, return_type string, entry_reason string, definitive boolean, supertypes array<string>, anonymous boolean, overrides boolean"
    methods = [m(1, "long", "a", 10, 200, "long"), m(2, "short", "a", 210, 230, "short"), m(3, "entry", "h", 300, 390, "serve", entry_reason="GET /", definitive=True), m(4, "mid", "h", 1, 90, "mid"), m(5, "away", "gone", 1, 9, "away"), m(6, "pred", "a", 240, 245, "pred", return_type="boolean")]
    calls = [(1, 3, "h", 350, "mid", 0), (2, 4, "h", 80, "long", 0), (3, 1, "a", 20, "short", 0), (4, 1, "a", 22, "away", 0), (5, 1, "a", 24, "pred", 0), (6, 1, "a", 150, "serve", 0), (7, 1, "a", 23, "nowhere", 0)]
    edges = [("entry", "mid", 1), ("mid", "long", 2), ("long", "short", 3), ("long", "away", 4), ("long", "pred", 5), ("long", "entry", 6)]
    candidates = [(1, "a", 100, "a", 100), (1, "a", 100, "a", 100), (2, "lost", 3, "a", 205), (3, "a", None, "void", 1), (4, "h", 310, "h", 311), (5, "a", 25, "a", 199)]
    df = spark.createDataFrame([(*c, "x", "y") for c in candidates], "sink long, source_file string, source_line int, sink_file string, sink_line int, file string, text string")
    args = (files, spark.createDataFrame(methods, kind), spark.createDataFrame(calls, "call_seq long, caller_seq long, file string, line int, callee string, arity int"), spark.createDataFrame(edges, "caller string, callee string, seq long"), spark.createDataFrame([], "literal string, file string"))
    got = {r.sink: r.context for r in P.prompt_context(df, *args).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    show = lambda lo, hi: "\n".join(f"{i:>5} | line {i}" for i in range(lo, hi + 1))
    assert got[1] == (
        f"## Source and sink: a\n{show(10, 21)}\n      | ... 63 lines omitted ...\n{show(85, 115)}"
        f"\n\n## Calls from entries\nmid() at h:80 <- serve() at h:350\nEntry: serve() in h, GET /\n{show(292, 308)}"
        f"\n\n-- serve() in h, calls on at line 350\n{show(300, 300)}\n      | ...\n{show(313, 352)}"
        f"\n\n-- mid() in h, calls on at line 80\n{show(1, 1)}\n      | ...\n{show(43, 82)}\n"
        f"\n\n## Called on the way\n\naway() in gone\n(no such file)\n\nshort() in a\n{show(210, 230)}"
    )
    assert got[2] == f"## Source: lost\n(no such file: lost)\n\n## Sink: a\n{show(190, 220)}\n\n## Calls from entries\nNo method is around this line."
    assert got[3] == "## Source: a\n(no such file: a)\n\n## Sink: void\n\n\n## Calls from entries\nNo method is around this line."
    assert got[4] == f"## Source: h\n{show(300, 390)}\n\n## Sink: h\n{show(300, 390)}\n\n## Calls from entries\nThe sink is inside an entry."
    assert got[5].startswith(f"## Source: a\n{show(10, 21)}\n      | ... 0 lines omitted ...\n{show(22, 40)}\n\n## Sink: a\n") and "serve() in h\n" in got[5].split("## Called on the way")[1]
    assert P.prompt_context(df.limit(0), *args).count() == 0


def test_texts_are_split_once_for_their_counts(spark, monkeypatch):
    """What asks how many lines a file has reads it from a table."""
    from riskloom.plans import prompts

    plans, cut = {}, prompts.cut
    monkeypatch.setattr(prompts, "cut", lambda df, name="graph", by=None: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and cut(df, name, by))
    prompts._code(spark, "/root/testdata/sf0.001")
    assert "split(" in plans["counts"] and "split(" not in plans["methods"] + plans["calls"]


def test_notes_follow_callers_as_far_as_they_go(spark):
    """All ends of more than 200 callers are found, and what a far end decides is decided."""
    from riskloom.plans import prompts

    one = lambda n, **more: tuple(({"node": n, "file": f"{n}.x", "owner": "", "name": n, "supertypes": [], "anonymous": False, "overrides": False} | more).values())
    wide = [(f"w{i:03}", "w", 1000 + i) for i in range(300)] + [("main", f"w{i:03}", 2000 + i) for i in range(300)]
    fan = [(f"e{i:03}", "f", 3000 + i) for i in range(300)] + [("far", "e007", 4000)]
    methods = [one("c"), one("c1"), one("c2", name="main"), one("main"), one("w"), one("f"), one("far", overrides=True, supertypes=["T"])] + [one(f"{x}{i:03}") for x in "we" for i in range(300)]
    tables = [spark.createDataFrame([(1, "c"), (2, "w"), (3, "f")], "sink long, node string"), spark.createDataFrame(methods, METHODS), spark.createDataFrame([("c1", "c", 1), ("c2", "c1", 2), *wide, *fan], "caller string, callee string, seq long"), spark.createDataFrame([], "literal string, file string")]
    assert {r.sink: (r.outcome, r.note) for r in unreachable_notes(*tables).collect()} == {
        1: ("startup", "Runs at startup only; all callers begin at main() in c2.x."),
        2: ("startup", "Runs at startup only; all callers begin at main() in main.x."),
        3: ("overrides", "No entry within reach; callers begin at e000() in e000.x; e001() in e001.x; e002() in e002.x; e003() in e003.x (+296 more). Overridden types: T."),
    }
    assert {r.sink: r.outcome for r in unreachable_notes(*tables, cap=200).collect()} == {1: "startup", 2: "internal", 3: "internal"}
    assert "200" not in prompts.ORACLES["unreachable_notes"].split("w(start")[1] and "q.n < 200" in prompts.ORACLES["prompt_context"]
