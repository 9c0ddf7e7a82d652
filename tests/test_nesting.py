"""Enclosing spans and taint by running sums, against plain versions and on awkward rows."""

import random

from riskloom.operators import nesting as Y

SPANS = "span long, file string, start long, end long, kind string, _row string, n long"


def nested(r, file, start, end, out, depth=0):
    """Random nested spans of a file, equal and empty ones among them."""
    at = start
    while at < end and len(out) < 220:
        stop = r.randrange(at, end + 1)
        out.append((len(out), file, at, stop, r.choice("abc"), "x", 0))
        if r.random() < 0.2:
            out.append((len(out), file, at, stop, r.choice("abc"), "x", 0))
        if depth < 5 and stop > at:
            nested(r, file, at, stop, out, depth + 1)
        at = stop + r.randrange(0, 3)


def holds(o, s):
    return o[0] != s[0] and o[1] == s[1] and o[2] <= s[2] and s[3] <= o[3] and (o[2] < o[3] or (s[2], s[3]) == (o[2], o[3])) and (s[2] < s[3] or s[2] < o[3] or (s[2], s[3]) == (o[2], o[3]))


def test_around_against_plain(spark):
    r = random.Random(4)
    rows = []
    for f in ("f", "g"):
        nested(r, f, 0, 300, rows)
    got = {x.span: (x.a, x.bc) for x in Y.around(spark.createDataFrame(rows, SPANS), {"a": "kind = 'a'", "bc": "kind <> 'a'"}).collect()}
    want = {s[0]: tuple(sum(holds(o, s) and (o[4] == "a") == k for o in rows) for k in (True, False)) for s in rows}
    assert got == want and max(x for x, _ in want.values()) > 2


def test_around_of_awkward_rows(spark):
    rows = [(1, "f", 0, 10, "a"), (1, "f", 0, 10, "a"), (2, "f", None, 5, "a"), (3, None, 0, 5, "a"), (4, "f", 10, 12, "b"), (5, "f", 3, 5, None), (6, "f", 3, 3, "b"), (7, "g", 3, 5, "b")]
    df = spark.createDataFrame(rows, "span long, file string, start long, end long, kind string")
    got = sorted((x.span, x.n) for x in Y.around(df, {"n": "kind = 'a'"}).collect())
    assert got == [(1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 2), (6, 2), (7, 0)]
    assert Y.around(df.limit(0), {"n": "true"}).count() == 0


def test_enclosed(spark):
    hits = spark.createDataFrame([(1, "f", 5, 6), (2, "f", 15, 16), (3, "f", 25, 26), (4, "g", 5, 6)], "span long, file string, start long, end long")
    among = spark.createDataFrame([(9, "f", 0, 20, "in"), (8, "f", 14, 18, "out"), (7, "f", 5, 6, "out2")], "span long, file string, start long, end long, kind string")
    pick = lambda **k: sorted(x.span for x in Y.enclosed(hits, among=among, **k).collect())
    assert pick(inside="kind = 'in'") == [1, 2] and pick(inside="kind = 'in'", not_inside="kind = 'out'") == [1] and pick(not_inside="kind LIKE 'out%'") == [3, 4] and pick() == [1, 2, 3, 4]
    assert Y.enclosed(hits, inside="kind = 'in'", among=among).columns == hits.columns


def test_tainted_uses_against_plain(spark):
    r = random.Random(6)
    given = [(r.randrange(3), r.choice("xy"), r.randrange(60), r.random() < 0.4) for _ in range(60)] + [(None, "x", 1, True), (0, None, 1, True), (1, "z", 5, None)]
    uses = [(i, r.randrange(3), r.choice("xyz"), r.randrange(60), "s") for i in range(80)] + [(90, None, "x", 9, "s"), (91, 0, None, 9, "s"), (92, 1, "z", 9, "s"), (92, 1, "z", 9, "s")]
    got = sorted((x.id, x.tainted) for x in Y.tainted_uses(spark.createDataFrame(given, "unit long, name string, at long, source boolean"), spark.createDataFrame(uses, "id long, unit long, name string, at long, source string")).collect())

    def plain(unit, name, at):
        before = [(a, bool(s)) for u, n, a, s in given if u is not None and n is not None and (u, n) == (unit, name) and a <= at]
        return max(before)[1] if before else False

    assert got == sorted((i, plain(u, n, a)) for i, u, n, a, _ in uses)
