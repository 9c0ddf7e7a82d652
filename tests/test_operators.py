import json
import os
import random
import tempfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from riskloom.functions import storage
from riskloom.operators import analytics, candidates, context, frontends, graph, ingest, javatypes, references, reports, rules, session, typed, validators, verify
from riskloom.sources import fixtures


def cands(spark, rows):
    """(seq, rule, source_file, source_line, sink_file, sink_line, mode)"""
    return spark.createDataFrame(rows, "seq int, rule_id string, source_file string, source_line int, sink_file string, sink_line int, verification_mode string").withColumn("message", F.concat(F.lit("m-"), "rule_id"))


def test_dedup(spark):
    df = cands(spark, [(2, "b", "f", 1, "f", 1, "static"), (1, "a", "f", 1, "f", 1, "dataflow"), (3, "a", "f", 1, "f", 1, "static"), (4, "a", "g", 2, "f", 1, "static")])
    got = {r.seq: r for r in candidates.dedup(df).collect()}
    assert got[1].rule_ids == ["a", "b", "a"] and got[1].messages == ["m-a", "m-b", "m-a"] and got[1].verification_mode == "dataflow" and got[1].rule_id == "a"
    assert got[4].rule_ids == ["a"] and got[4].verification_mode == "static"


def test_copies(spark):
    df = cands(spark, [(1, "a", "x/A", 3, "x/A", 3, "s"), (2, "a", "y/A", 3, "y/A", 3, "s"), (3, "a", "z/A", 3, "z/A", 3, "s"), (4, "a", "gone1", 3, "gone1", 3, "s"), (5, "a", "gone2", 3, "gone2", 3, "s"), (6, "b", "x/A", 3, "x/A", 3, "s")])
    df = df.withColumn("rule_ids", F.array("rule_id"))
    files = spark.createDataFrame([("x/A", "package x;\nimport q;\n a \nb"), ("y/A", "package y;\n a\nb"), ("z/A", "package y;\n a\nc")], "file string, text string").select("file", candidates.fingerprint(F.col("text")).alias("fingerprint"))
    got = {r.seq: r.duplicate_locations for r in candidates.dedup_copies(df, files).collect()}
    assert got == {1: ["y/A"], 3: [], 4: [], 5: [], 6: []}


def test_normalize(spark):
    trace = json.dumps({"taint_source": ["CliLoc", [{"path": "p", "start": {"line": 4}}, "v"]]})
    schema = "check_id string, path string, start struct<line:int>, extra struct<message:string,severity:string,metadata:struct<cwe:array<string>>,dataflow_trace:string>"
    rows = [("r", "/w/a.x", (9,), ("m", "ERROR", (["CWE-1"],), trace)), ("r", "/w/a.x", (9,), ("m", "ERROR", (["CWE-1"],), None)), ("r", "/v/b", (2,), ("m", "INFO", (None,), "{bad"))]
    got = [(r.sink_file, r.source_line, r.sink_line, r.is_intraprocedural) for r in candidates.normalize(spark.createDataFrame(rows, schema), "/w").collect()]
    assert got == [("a.x", 4, 9, False), ("a.x", 9, 9, True), ("/v/b", 2, 2, True)]


def test_rule_stats_verdicts(spark):
    finding = "struct<reachable:string,reasoning:string>"
    rows = [("r1", "f", [], ["a"], "a", ("yes", "")), ("r1", "f", [], ["a", "b"], "a", ("no", "")), ("r2", "f", [], ["a"], "a", ("maybe", "")), ("r2", "f", [], ["a"], "a", ("yes", "verifier_failed: x")), ("r2", "f", [], [], "a", None)]
    df = spark.createDataFrame(rows, f"report_id string, sink_file string, cwe array<string>, rule_ids array<string>, rule_id string, finding {finding}")
    got = {r.rule: r.asDict() for r in analytics.rule_stats(df).collect()}
    assert got["a"] == {"rule": "a", "hits": 5, "solo_hits": 4, "yes": 1, "no": 1, "uncertain": 1, "failed": 1, "unverified": 1, "reports": 2}
    assert got["b"]["solo_hits"] == 0 and analytics.noisy_rules(df).count() == 0
    assert analytics.summary(df).collect()[0].asDict() == {"total": 5, "reachable": 1, "uncertain": 1, "not_reachable": 1, "verifier_failed": 1, "unverified": 1}
    assert analytics.agreement(spark.createDataFrame([], "verdict string, expected string")).collect()[0].asDict() == {"total": 0, "matched": 0, "agree": 0, "pct": 0.0}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "caller string, callee string")


def test_trace(spark):
    e = edges(spark, [("h", "m"), ("m", "s"), ("h2", "s"), ("s", "s"), ("up", "h"), ("c1", "c2"), ("c2", "c1"), ("c1", "s")])
    sinks = spark.createDataFrame([("S", "s"), ("H", "h"), ("O", "o")], "sink string, node string")
    entries = spark.createDataFrame([("h",), ("h2",), ("up",)], "node string")
    got = {(r.sink, r.entry): (r.depth, r.path) for r in graph.trace_to_entries(sinks, e, entries).collect()}
    assert got == {("S", "h2"): (1, ["s", "h2"]), ("S", "h"): (2, ["s", "m", "h"]), ("H", "h"): (0, ["h"])}
    assert {(r.sink, r.entry) for r in graph.trace_to_entries(sinks, e, entries, 1).collect()} == {("S", "h2"), ("H", "h")}


def test_closure_and_leaves(spark):
    t = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "type string, parent string")
    assert {(r.type, r.ancestor) for r in graph.ancestors(t).collect()} == {(x, y) for x in "abc" for y in "abc" if x != y} | {("d", y) for y in "abc"}
    got = graph.leaves(spark.createDataFrame([("s",), ("x",)], "node string"), edges(spark, [("m", "s"), ("m", "m"), ("k", "m"), ("l", "m")])).collect()
    assert sorted((r.start, r.leaf) for r in got) == [("s", "k"), ("s", "l"), ("x", "x")]


def test_enclosing(spark):
    spans = spark.createDataFrame([("f", 1, 100, "outer", 0), ("f", 5, 70, "mid", 1), ("f", 5, 70, "twin", 2), ("g", 1, 2, "g", 3)], "file string, start int, end int, name string, seq int")
    points = spark.createDataFrame([(1, "f", 66), (2, "f", 80), (3, "f", 101), (4, "h", 1)], "point int, file string, line int")
    assert {r.point: r.name for r in graph.enclosing(points, spans).collect()} == {1: "mid", 2: "outer", 3: None, 4: None}


def test_references(spark):
    m = spark.createDataFrame([(1, "f", "h", None, False), (2, "f", "k", "GET", True), (3, "g", "h", "hint", False)], "method_seq int, file string, name string, entry_reason string, definitive boolean")
    r = spark.createDataFrame([(2, "f", "h", "second"), (1, "f", "h", "first"), (3, "f", "k", "no"), (4, "g", "h", "late")], "ref_seq int, file string, name string, reason string")
    got = {x.method_seq: (x.entry_reason, x.definitive) for x in references.apply_references(m, r, ["file", "name"]).collect()}
    assert got == {1: ("first", True), 2: ("GET", True), 3: ("late", True)}
    got = {x.method_seq: x.entry_reason for x in references.apply_references(m, r, ["file", "name"], last=True, only_blank=True).collect()}
    assert got == {1: "second", 2: "GET", 3: "hint"}
    types = spark.createDataFrame([(["int"], ["long"]), (["int"], ["string"]), (["int"], ["T"]), (["int"], []), ([""], ["x"])], "a array<string>, p array<string>")
    assert [x[0] for x in types.select(references.types_fit(F.col("a"), F.col("p"))).collect()] == [True, False, True, True, True]
    d = spark.createDataFrame([("T", ["a"], 1), ("T", ["b"], 2)], "type string, parents array<string>, decl_seq int")
    assert references.supertypes(d).count() == 2 and [x.parent for x in references.supertypes(d, True).collect()] == ["b"]
    v = spark.createDataFrame([("C", 1, None), ("C", 2, "private"), ("C", 3, None), ("D", 4, None)], "class string, pos int, marker string")
    assert [x.visibility for x in references.visibility(v).orderBy("pos").collect()] == ["public", "private", "private", "public"]


def test_frontends(spark):
    rows = frontends.extract(fixtures.files(spark)).cache()
    linked = {(r.file, r.name): (r.entry_reason, r.definitive) for r in frontends.linked_entries(rows).collect()}
    assert linked[("shop/OrderController.java", "list")] == ("@GetMapping", True)
    assert linked[("shop/Echo.java", "doGet")] == ("servlet doGet", True)
    assert linked[("web/app.py", "find")] == ("@route /find", True)
    assert linked[("web/server.js", "show")] == ("GET /show", True)
    assert linked[("svc/main.go", "Handle")] == ("HANDLEFUNC /h", True)
    assert linked[("play/Home.scala", "index")] == ("GET /play", True)
    assert linked[("svc/main.go", "work")] == ("request parameter", False)
    calls = {(r.caller, r.callee) for r in frontends.call_edges(rows).collect()}
    assert ("shop/OrderController.java#0", "shop/OrderService.java#0") in calls and ("shop/OrderService.java#0", "shop/OrderService.java#1") in calls
    assert frontends.rows_of("bad.py", "def (") == [] and frontends.rows_of("bad.xml", "<mapper>") == [] and frontends.rows_of("x.txt", "a") == []


def test_rules(spark):
    hits = {(r.file, r.line, r.rule_id) for r in rules.match(rules.call_sites(fixtures.files(spark))).collect()}
    assert hits == {
        ("map/UserMapper.xml", 3, "mybatis-string-substitution-in-sql"),
        ("native/io.cpp", 4, "CPP004"), ("native/io.cpp", 6, "CPP009"), ("native/io.cpp", 7, "CPP010"), ("native/io.cpp", 8, "CPP002"), ("native/io.cpp", 12, "CPP005"), ("native/io.cpp", 14, "CPP006"),
        ("shop/Echo.java", 5, "wrapped-request-param-into-response-writer"),
        ("shop/OrderController.java", 9, "spel-injection-inline-parser"),
        ("shop/OrderService.java", 7, "url-from-nonconstant-segment"),
        ("web/app.py", 7, "sql-string-built-from-nonconstant-segment"),
    }


def test_more_rules(spark):
    code = {
        "a.cs": 'class A { void F(string x) {\n Process.Start(x);\n Process.Start("ls");\n File.ReadAllText(x);\n Response.Write(x);\n Response.Write(HtmlEncode(x));\n nav.SelectNodes("//a" + x);\n } }\n',
        "b.rs": 'fn f(x: &str) {\n let o = Command::new("sh").arg("-c").arg(x).output();\n let p = Command::new("ls").arg(x).output();\n db.query(&format!("SELECT {}", x));\n}\n',
        "c.kt": 'fun f(x: String) {\n  db.rawQuery("SELECT * FROM t WHERE a = $x", null)\n  db.rawQuery("SELECT 1", null)\n}\n',
        "D.java": 'class D {\n void f(HttpServletRequest request) {\n  String q = request.getParameter("q");\n  st.executeQuery("SELECT " + q);\n  new File(q);\n  session.setAttribute("a", q);\n  st.executeQuery("SELECT 1");\n }\n}\n',
    }
    df = spark.createDataFrame(sorted(code.items()), "path string, text string")
    hits = {(r.file, r.line, r.rule_id) for r in rules.match(rules.call_sites(df)).collect()}
    assert {h for h in hits if h[0] == "a.cs"} == {("a.cs", 2, "process-start-single-argument"), ("a.cs", 4, "file-open-with-nonconstant-path"), ("a.cs", 5, "response-write-unencoded"), ("a.cs", 7, "xpath-query-with-nonconstant-argument")}
    assert {h for h in hits if h[0] == "b.rs"} == {("b.rs", 2, "rust-shell-invocation-with-nonconstant-command"), ("b.rs", 4, "rust-sql-string-built-from-nonconstant-segment")}
    assert {h for h in hits if h[0] == "c.kt"} == {("c.kt", 2, "kotlin-sql-string-built-from-nonconstant-segment")}
    assert {h[1:] for h in hits if h[0] == "D.java" and h[2].startswith("wrapped")} == {(4, "wrapped-request-param-into-sql"), (5, "wrapped-request-param-into-file-path"), (6, "wrapped-request-param-into-session-attribute")}
    assert len({r.id for r in rules.RULES}) == 30


def test_validators(spark):
    assert validators.null_dereference({"code": "p = q; q = 0; r = nullptr; x = r; x->y", "offset": 36, "symbol": "x"})
    assert not validators.null_dereference({"code": "x = 0; if (!x) return; x->y", "offset": 23, "symbol": "x"})
    assert validators.dangerous_file_operation({"callee": "chmod", "arguments": ["p", "0777"]}) and not validators.dangerous_file_operation({"callee": "chmod", "arguments": ["p", "0755"]})
    assert not validators.standard_function_call({"code": "#define gets(x) 0\nint f() { gets(a); }", "offset": 28, "callee": "gets"})
    assert validators.hardcoded_secret({"code": 'k = "s3"; ', "offset": 10, "expression": "k"}) and not validators.hardcoded_secret({"code": "", "offset": 0, "expression": "k"})
    dangerous = lambda name, *args, **more: validators.dangerous_file_operation({"callee": name, "arguments": list(args), **more})
    assert dangerous("tmpnam") and dangerous("fopen", '"/var/tmp/x"', '"r+"') and dangerous("fopen", '"c:\\\\TEMP\\\\x"', 'L"wb"') and not dangerous("fopen", '"/tmp/x"', '"r"') and not dangerous("fopen", '"/etc/x"', '"w"')
    assert dangerous("fopen", "name", '"w"', code="name = tmpnam(0); f = fopen(name, m);", offset=22) and not dangerous("fopen", "name", '"w"', code="name = safe(0); ", offset=16)
    assert dangerous("open", "p", "O_CREAT|O_RDWR", "0x1FF") and dangerous("chmod", "p", "511") and not dangerous("open", "p", "O_RDONLY", "0777") and not dangerous("chmod", "p", "mode")
    chain = "".join(f"v{i} = v{i - 1}; " for i in range(1, 60))
    assert validators._value("v59", len("v0 = NULL; " + chain), "v0 = NULL; " + chain) == "NULL" and validators._value("a", 30, "a = b; b = a; a = b; ") == ""


def test_ingest(spark, tmp_path):
    for name, entries in {"a": ["top/x.txt", "top/d/y.txt"], "b": ["p/x", "q/y", "../evil", "/abs"], "c": ["only"]}.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for e in entries:
                z.writestr(e, e)
    got = sorted((os.path.basename(r.archive), r.stripped, bytes(r.content).decode()) for r in ingest.read_archives(spark, str(tmp_path)).collect())
    assert got == [("a.zip", "d/y.txt", "top/d/y.txt"), ("a.zip", "x.txt", "top/x.txt"), ("b.zip", "p/x", "p/x"), ("b.zip", "q/y", "q/y"), ("c.zip", "only", "only")]
    (tmp_path / "d.zip").write_text("no archive")
    few = {(os.path.basename(r.archive), r.path, (r.refused or "").split(":")[0]) for r in ingest.read_archives(spark, str(tmp_path), max_entries=1).collect()}
    assert few == {("a.zip", None, "2 entries, 1 are allowed"), ("b.zip", None, "4 entries, 1 are allowed"), ("c.zip", "only", ""), ("d.zip", None, "not readable")}
    assert {r.refused for r in ingest.read_archives(spark, str(tmp_path), max_bytes=3).collect()} >= {"17 bytes, 3 are allowed"}


def test_reports(spark, tmp_path):
    (tmp_path / "r1.json").write_text(json.dumps({"project": "p", "findings": [{"rule_id": "a"}, {"rule_id": "b"}]}))
    (tmp_path / "r2.json").write_text("{broken")
    got = sorted((r.report_id, r.rule_id) for r in ingest.read_reports(spark, str(tmp_path), "rule_id:string").collect())
    assert got == [("r1", "a"), ("r1", "b")]
    df = spark.createDataFrame([("a",)], "rule_id string")
    ingest.write_report(df, spark.createDataFrame([(1,)], "total int"), str(tmp_path / "out"), "p")
    assert spark.read.json(str(tmp_path / "out/summary")).collect()[0].summary.total == 1


def test_verify(spark):
    asked = spark.createDataFrame([(i, f"q{i}") for i in range(6)], "n int, prompt string")

    class Busy(Exception):
        status, retry_after = 503, 0.0

    def flaky():
        seen = {}

        def chat(text):
            seen[text] = seen.get(text, 0) + 1
            if seen[text] == 1:
                raise Busy
            if seen[text] == 2:
                raise TimeoutError
            return '{"reachable": "yes"}'

        return chat

    assert {r.reply for r in verify.ask(asked, flaky, 1, base_wait=0.0).collect()} == {'{"reachable": "yes"}'}

    def picky():
        def chat(text):
            if text == "q3":
                raise ValueError("no such thing")
            return text

        return chat

    assert {r.n: r.reply for r in verify.ask(asked, picky, 2, base_wait=0.0).collect()} == {i: None if i == 3 else f"q{i}" for i in range(6)}

    def dead(log):
        def provider():
            def chat(text):
                with open(log, "a") as f:
                    f.write(text + "\n")
                raise ConnectionError

            return chat

        return provider

    with tempfile.TemporaryDirectory() as d:
        log = os.path.join(d, "log")
        got = verify.ask(asked.coalesce(1), dead(log), 1, attempts=3, base_wait=0.0, wave=2)
        assert [r.reply for r in got.collect()] == [None] * 6
        assert open(log).read().split() == ["q0"] * 3  # one call is exhausted, nothing else is asked
    assert verify.waits(6) == [0.0, 2.0, 4.0, 8.0, 16.0, 30.0]
    parsed = verify.parse_replies(spark.createDataFrame([('```json\n{"reachable": "no", "confidence": 5}\n```',), ("nonsense",), (None,)], "reply string")).collect()
    assert [r.finding.reachable for r in parsed] == ["no", "uncertain", "uncertain"] and "verifier_failed" in parsed[1].finding.reasoning
    ok = spark.createDataFrame([("a", "漏洞"), ("a", ""), ("a", "a")], "o string, t string").select(verify.valid_translation(F.col("o"), F.col("t"), "zh")).collect()
    assert [r[0] for r in ok] == [True, False, False]


def test_context(spark):
    text = "\n".join(f"l{i}" for i in range(1, 301))
    df = spark.createDataFrame([(text, 1, 300, 200), (text, 1, 5, 3)], "t string, a int, e int, at int").withColumn("ls", F.split("t", "\n"))
    long, short = [r[0] for r in df.select(context.method_window(F.col("ls"), F.col("a"), F.col("e"), F.col("at"))).collect()]
    assert "    1 | l1\n" in long and "  200 | l200" in long and "... 172 lines omitted ..." in long and "l100" not in long
    assert short == "\n".join(f"    {i} | l{i}" for i in range(1, 6))
    assert [r[0] for r in spark.createDataFrame([(1,), (10,), (100,)], "n int").select(context.hop_budget(F.col("n"))).collect()] == [40, 24, 10]
    hops = spark.createDataFrame([(1, 0, ["a", "b"], 1, 2), (1, 1, ["c"], 1, 1)], "path_id int, hop int, lines array<string>, start int, end int")
    assert context.path_text(hops).collect()[0].text == "    1 | c\n\n    1 | a\n    2 | b"
    filled = df.limit(1).select(context.prompt("at {at}: {none}!", at=F.col("at"), none=F.lit(None)))
    assert filled.collect()[0][0] == "at 200: !"


def test_ranked_over_ranges(spark):
    """A group that fills several ranges, null groups, and totals with nulls."""
    from riskloom.operators.ordered import ranked

    rows = [("hot", i, None if i % 5 == 0 else i) for i in range(200)] + [(None, i, 1) for i in range(3)] + [("one", 7, 2)]
    got = ranked(spark.createDataFrame(rows, "g string, o int, v int").repartition(3), ["g"], [F.col("o")], "n", {"total": "v"}).collect()
    assert len(got) == len(rows)
    for g in ("hot", None, "one"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.o)
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
        running = 0
        for r in mine:
            running += r.v or 0
            assert r.total == running


def test_last_value_over_ranges(spark):
    """Running last values: within and across ranges, with gaps, null groups, rows before only."""
    from riskloom.operators.ordered import last_value

    rows = [("hot", i, i if i % 7 == 0 else None) for i in range(200)] + [(None, i, None) for i in range(3)] + [("one", 7, 2)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(3)
    for ahead in (False, True):
        got = {(r.g, r.o): r.last for r in last_value(df, ["g"], [F.col("o")], "v", "last", ahead=ahead).collect()}
        for g in ("hot", None, "one"):
            last = None
            for _, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
                seen = last
                last = v if v is not None else last
                assert got[g, o] == (seen if ahead else last)


def test_trace_hints(spark):
    """A hinted entry is searched beyond and is its own entry only if nothing reaches it; paths take the smallest of equal ways."""
    e = edges(spark, [("h", "s"), ("a", "h"), ("p", "a"), ("p", "b"), ("b", "h"), ("q", "lone"), ("x", "y")])
    entries = spark.createDataFrame([("h", False), ("p", True), ("lone", False), ("y", True), ("y", False)], "node string, definitive boolean")
    sinks = spark.createDataFrame([(x, x) for x in ("s", "h", "lone", "y")], "sink string, node string")
    got = {(r.sink, r.entry): (r.depth, r.path) for r in graph.trace_to_entries(sinks, e, entries).collect()}
    assert got == {("s", "h"): (1, ["s", "h"]), ("h", "p"): (2, ["h", "a", "p"]), ("lone", "lone"): (0, ["lone"]), ("y", "y"): (0, ["y"])}
    bare = graph.trace_to_entries(sinks, e, entries, paths=False)
    assert bare.columns == ["sink", "entry", "depth"] and bare.count() == 4


def test_leaves_cap(spark):
    e = edges(spark, [(f"c{i}", "s") for i in range(5)] + [(f"d{i}", f"c{i}") for i in range(5)])
    start = spark.createDataFrame([("s",)], "node string")
    assert {r.leaf for r in graph.leaves(start, e).collect()} == {f"d{i}" for i in range(5)}
    assert graph.leaves(start, e, cap=4).count() == 0  # six nodes seen after one level: it stops there, before the leaves


def test_typed_callers(spark):
    """Same-named classes, interface dispatch, library receivers, overrides both ways, implied self in its file, unknown types."""
    m = [(1, "a/A", "run", 1, "A", "a.A", ["int"]), (2, "b/A", "run", 1, "A", "b.A", ["int"]), (3, "c/I", "run", 1, "I", "c.I", []), (4, "c/J", "run", 1, "J", "c.J", []), (5, "x", "run", -1, "", "", []), (6, "d/T", "run", 1, "T", "d.T", [])]
    methods = spark.createDataFrame([*m, (9, "a/A", "main", 0, "A", "a.A", []), (10, "c/J", "go", 0, "J", "c.J", [])], "method_seq int, file string, name string, arity int, owner string, qualified string, parameter_types array<string>")
    bare = spark.createDataFrame([("J", "I"), ("T", "Runnable")], "type string, ancestor string")
    full = spark.createDataFrame([("c.J", "c.I"), ("d.T", "?Runnable")], "type string, ancestor string")
    c = [(100, 9, "a/A", False, False, "", "b.A", []), (101, 9, "a/A", False, False, "", "c.I", []), (102, 9, "a/A", False, False, "", "?Runnable", []), (103, 9, "a/A", False, False, "", "~J", []), (104, 10, "c/J", True, False, "", "", []), (105, 9, "b/A", False, True, "", "", []), (106, 9, "a/A", False, False, "", "", ["string"]), (107, 9, "a/A", False, False, "const A &", "", [])]
    calls = spark.createDataFrame([(q, "run", 1, k, f, s, i, to, tq, a) for q, k, f, s, i, to, tq, a in c], "call_seq int, callee string, arity int, caller_seq int, file string, receiver_is_self boolean, implicit_self boolean, target_owner string, target_qualified string, argument_types array<string>")
    got = {q: set() for q in range(100, 108)}
    for r in typed.callers(methods, calls, bare, full).collect():
        got[r.call_seq].add(r.method_seq)
    assert got == {100: {2, 5}, 101: {3, 4, 5}, 102: {6, 5}, 103: {3, 4, 5}, 104: {3, 4, 5}, 105: {1, 2, 5}, 106: {3, 4, 5, 6}, 107: {1, 2, 5}}


def test_declarations(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None), ("c", "x"), ("d", None)], "k string, form string")
    assert {r.k: r.form for r in references.only_form(d, ["k"], "form").collect()} == {"a": "x", "b": None, "c": None, "d": None}
    inc = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "gone")], "file string, included string")
    mac = spark.createDataFrame([("c", "M"), ("d", "N")], "file string, name string")
    assert {(r.file, r.name) for r in references.visible_macros(inc, mac).collect()} == {("a", "M"), ("b", "M"), ("c", "M"), ("d", "N")}
    items = spark.createDataFrame([("A", 1, "mark", "@x"), ("A", 2, "mark", "@y"), ("A", 3, "method", "f"), ("A", 4, "mark", "@z"), ("A", 5, "other", "o"), ("A", 6, "method", "g")], "body string, pos int, kind string, name string")
    assert {r.name: r.marks for r in references.attach_pending(items).collect()} == {"f": ["@x", "@y"], "o": [], "g": []}
    blocks = spark.createDataFrame([(1, None, "/a"), (2, 1, "/b"), (3, 2, None), (4, 3, "/c"), (5, 99, "/z")], "block int, parent int, segment string")
    assert {r.block: r.route for r in references.route_prefixes(blocks).collect()} == {1: "/a", 2: "/a/b", 3: "/a/b", 4: "/a/b/c", 5: "/z"}
    with pytest.raises(RuntimeError):
        references.route_prefixes(spark.createDataFrame([(1, 2, "/a"), (2, 1, "/b")], "block int, parent int, segment string"))


def test_taint_order(spark):
    """Only what a variable was last given before the sink counts."""
    code = """class D {
 void f(HttpServletRequest request) {
  st.executeQuery("SELECT " + early);
  String early = request.getParameter("q");
  String q = request.getParameter("q");
  st.executeQuery("SELECT " + q);
  q = encode(q);
  st.executeQuery("SELECT " + q);
 }
}
"""
    hits = {r.line for r in rules.match(rules.call_sites(spark.createDataFrame([("D.java", code)], "path string, text string"))).collect() if r.rule_id == "wrapped-request-param-into-sql"}
    assert hits == {6}


def test_bad_files_cost_their_own_rows(spark):
    deep = [("good.py", "def f(a):\n    g(a)\n"), ("sum.py", "x = " + " + ".join(["f(1)"] * 4000)), ("chain.py", "x = a" + ".b" * 3000 + "()"), ("nested.py", "x = " + "(" * 3000 + ")" * 3000), ("null.py", "a\0b"), ("none.py", None)]
    rows = frontends.extract(spark.createDataFrame(deep, "path string, text string")).groupBy("file").count().collect()
    assert {r.file: r["count"] for r in rows} == {"good.py": 2, "sum.py": 4000, "chain.py": 1}


def test_snippets_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("äbc".encode(), 0, 3), ("äbc".encode(), 1, 3), (b"abc", 1, 99), (b"abc", 9, 12), (b"abc", None, 2), (None, 0, 1), (b"abc", 2, 1)], "c binary, a int, e int")
    assert [r[0] for r in df.select(candidates.snippet(F.col("c"), F.col("a"), F.col("e"))).collect()] == ["äb", "\ufffdb", "bc", "", "", "", ""]
    (tmp_path / "c.json").write_text('[{"rule_id": "a"}, {"rule_id": "b"}]')
    (tmp_path / "bad.json").write_text("[{broken")
    (tmp_path / "object.json").write_text('{"x": 1}')
    got = lambda name: sorted(r.rule_id for r in ingest.read_candidates(spark, str(tmp_path / name), "rule_id string").collect() if r.rule_id)
    assert got("c.json") == ["a", "b"] and got("bad.json") == got("missing.json") == got("object.json") == []


def test_report_documents(spark, tmp_path):
    finding = "struct<reachable:string,reasoning:string,reasoning_zh:string,confidence:int>"
    rows = [("r", "high", "SQL", "k1", "s\\a", 3, "s\\a", 3, "AV:N", 7.5, ["CWE-89"], ["m <1>", "m2"], "yes", ("yes", "why & <how>", "为什么", 80)), ("r", "low", "XSS", "k2", "b", 1, "c/b", 2, "AV:L", 2.0, ["CWE-79"], ["m"], "unverified", None), ("q", "high", "SQL", "k3", "z", 1, "z", 1, "AV:N", 7.5, [], ["m"], "no", ("no", "", None, None))]
    df = spark.createDataFrame(rows, f"report_id string, risk_level string, vuln_type string, dedup_key string, source_file string, source_line int, sink_file string, sink_line int, cvss_vector string, cvss_score double, cwe array<string>, messages array<string>, verdict string, finding {finding}")
    reports.write_documents(reports.markdown(df, "zh", spark.createDataFrame([("r",), ("empty",)], "report_id string")), str(tmp_path / "md"))
    text = lambda kind, report: "".join(p.read_text() for p in sorted((tmp_path / kind / f"report_id={report}").glob("part-*")))
    assert text("md", "empty").startswith("# 发现: empty\n\n| 总数 |") and text("md", "empty").rstrip().endswith("没有发现。")
    md = text("md", "r")
    assert md.index("## 高 (1)") < md.index("### 1. SQL - `s/a:3`") < md.index("- **理由** 为什么") < md.index("## 低 (1)") < md.index("- **来源** `b:1`")
    reports.write_documents(reports.html(df), str(tmp_path / "html"))
    page = text("html", "r")
    assert page.startswith("<!DOCTYPE html>") and page.rstrip().endswith("</body></html>") and page.count("<details") == 2
    assert 'data-zh="为什么" data-en="why &amp; &lt;how&gt;">why &amp; &lt;how&gt;</p>' in page and "m &lt;1&gt; / m2" in page
    summary = df.groupBy("report_id").agg(F.count("*").alias("total"))
    reports.write_documents(reports.report_json(df, summary), str(tmp_path / "json"))
    made = json.loads(text("json", "r"))
    assert made["project"] == "r" and made["summary"] == {"total": 2} and [f["dedup_key"] for f in made["findings"]] == ["k1", "k2"]


def test_java_types(spark):
    """A spelled type by its file's own types, single imports, package, on-demand imports; bare, foreign, nested and primitive names."""
    types = spark.createDataFrame([("a/A", "a", "A", "a.A"), ("a/A", "a", "In", "a.A.In"), ("a/B", "a", "B", "a.B"), ("b/B", "b", "B", "b.B"), ("c/D", "c", "D", "c.D"), ("d/D", "d", "D", "d.D"), ("N", "", "N", "N")], "file string, package string, name string, qualified string")
    imports = spark.createDataFrame([("a/A", "b", "B", 0), ("a/A", "lib", "List", 1), ("a/B", "d", "*", 1), ("a/B", "c", "*", 0), ("a/A", "x.y", "*", 2)], "file string, package string, name string, seq int")
    want = {
        ("a/A", "In"): "a.A.In", ("a/A", "B"): "b.B", ("a/A", "List<Map<String, B>>[]"): "?List", ("a/A", "D"): "~D", ("a/A", "Nowhere"): "?Nowhere", ("a/A", "int"): "", ("a/A", "final @Nullable B..."): "b.B",
        ("a/B", "D"): "c.D", ("a/B", "A.In"): "a.A.In", ("a/B", "c.D"): "c.D", ("a/B", "java.util.Map.Entry"): "?Entry", ("a/B", "A.Gone"): "?Gone", ("N", "N"): "N", ("N", "B"): "~B", ("a/B", ""): "",
    }
    got = javatypes.resolve(spark.createDataFrame(list(want), "file string, text string"), types, imports).collect()
    assert {(r.file, r.text): r.meaning for r in got} == want and len(got) == len(want)


def test_java_receivers(spark):
    code = """package p.q;
import lib.Thing;
class Outer extends Base {
  private Thing field;
  static class Inner { void deep() { go(); } }
  void run(Param<X> given, final Other... more) {
    Local here = make();
    var made = new Fresh(1);
    here.a(); made.b(); given.c(); field.d(); this.field.e(); Util.f(); unknown.g(); LOGGER.h();
    new Fresh(2).i(); ((Cast) given).j(); here.chain().k(); more.l(); this.m(); n();
    for (Item item : given) item.o();
    Later here2 = null;
  }
  void other() { here.p(); field.r(); }
}
"""
    rows = frontends.rows_of("p/Outer.java", code)
    calls = {r["name"]: r for r in rows if r["kind"] == "call"}
    assert {n: calls[n]["spelled"] for n in "abcdefghijklmnopr"} == {"a": "Local", "b": "Fresh", "c": "Param<X>", "d": "Thing", "e": "Thing", "f": "Util", "g": "", "h": "", "i": "Fresh", "j": "Cast", "k": "", "l": "Other...", "m": "", "n": "", "o": "Item", "p": "", "r": "Thing"}
    assert calls["n"]["implicit_self"] and calls["go"]["implicit_self"] and not calls["Fresh"]["implicit_self"] and calls["m"]["receiver_is_self"]
    assert {r["name"]: r["qualified"] for r in rows if r["kind"] in ("type", "method")} == {"Outer": "p.q.Outer", "Inner": "p.q.Outer.Inner", "deep": "p.q.Outer.Inner", "run": "p.q.Outer", "other": "p.q.Outer"}
    assert [(r["package"], r["name"]) for r in rows if r["kind"] == "import"] == [("lib", "Thing")]


def test_java_dispatch(spark):
    """Same-named classes in two packages, an interface's implementers, overrides through this, library receivers."""
    files = {
        "a/Svc.java": "package a;\npublic class Svc { public void work(int x) { } }\n",
        "b/Svc.java": "package b;\npublic class Svc { public void work(int x) { } }\n",
        "b/Face.java": "package b;\npublic interface Face { void act(int x); }\n",
        "b/Impl.java": "package b;\npublic class Impl implements Face { public void act(int x) { this.hook(); } public void hook() { } }\n",
        "b/Sub.java": "package b;\npublic class Sub extends Impl { public void hook() { } }\n",
        "c/Main.java": "package c;\nimport b.*;\nimport a.Svc;\npublic class Main {\n  void main() {\n    Svc s = null; s.work(1);\n    Face f = null; f.act(2);\n    java.util.List l = null; l.hook();\n  }\n}\n",
    }
    rows = frontends.extract(spark.createDataFrame(sorted(files.items()), "path string, text string")).cache()
    name = {r.id: f"{r.file}:{r.name}" for r in rows.where("kind = 'method'").collect()}
    got = {(name[r.caller], name[r.callee]) for r in frontends.call_edges(rows).collect()}
    assert got == {("c/Main.java:main", "a/Svc.java:work"), ("c/Main.java:main", "b/Impl.java:act"), ("b/Impl.java:act", "b/Impl.java:hook"), ("b/Impl.java:act", "b/Sub.java:hook")}


def test_run_stages(spark):
    """Statuses in order, a pause that is waited for, failures, and a cancellation that ends a running job."""
    said, held = [], [True, True, False]
    assert session.run_stages(spark, [("scanning", lambda: 1), ("reporting", lambda: 2)], said.append, paused=lambda: held.pop(0) if held else False, poll=0.01) == [1, 2]
    assert said == ["paused", "scanning", "reporting", "done"]
    said.clear()
    with pytest.raises(ZeroDivisionError):
        session.run_stages(spark, [("scanning", lambda: 1 // 0)], said.append, poll=0.01)
    assert said == ["scanning", "failed"]
    said.clear()
    began = time.time()
    slow = lambda: spark.range(0, 8, 1, 8).mapInPandas(lambda it: (time.sleep(30) or x for x in it), "id long").count()
    with pytest.raises(session.Cancelled):
        session.run_stages(spark, [("scanning", slow), ("reporting", lambda: 2)], said.append, cancelled=lambda: time.time() > began + 2, poll=0.1)
    assert said == ["scanning", "cancelled"] and time.time() < began + 25
    assert spark.range(3).count() == 3
    with pytest.raises(session.Cancelled):
        session.run_stages(spark, [("scanning", lambda: 1)], said.append, cancelled=lambda: True, poll=0.01)


def test_callee_bodies_and_tables(spark):
    callees = spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "sink int, rank int, method_seq int")
    methods = spark.createDataFrame([(7, "f", 2, 3), (8, "f", 1, 90)], "method_seq int, file string, start int, end int")
    files = spark.createDataFrame([("f", [f"l{i}" for i in range(1, 100)])], "file string, lines array<string>")
    got = {r["rank"]: r.text for r in context.callee_bodies(callees, methods, files).collect()}
    assert got[1] == "    2 | l2\n    3 | l3" and got[2].count("\n") == 39 and got[2].endswith("   40 | l40")
    lines = session.text_table(spark.createDataFrame([("a", 5), ("long", 12), (None, None)], "name string, n int"), [F.negate(F.coalesce("n", F.lit(-1)))], ["name", "n"]).orderBy("line").collect()
    assert [r.text for r in lines] == ["name   n", "long  12", "a      5", ""]


def test_many_calls_of_one_method_are_small_rows(spark):
    n = 10_000
    text = "class D {\n void f(HttpServletRequest request) {\n  String q = request.getParameter(\"q\");\n" + "".join(f"  v{i} = q; st.execute(v{i});\n" for i in range(n)) + " }\n}\n"
    sites = list(rules._sites("D.java", text))
    assert len(sites) > n and sum(len(str(v)) for r in sites for v in r.values() if v is not None) < 50 * 2**20 / 4
    assert [r["unit"] for r in sites if r["callee"] is None] == [0] and sum(len(r["text"] or "") for r in sites) < len(text)
    late = 'class E {\n void f(HttpServletRequest request) {\n  st.execute(request.getParameter("a"));\n  a = request.getHeader("h"); st.execute(b + a);\n  a = clean(st.execute(a));\n  st.execute(a);\n }\n}\n'
    assert [r["tainted"] for r in rules._sites("E.java", late) if r["callee"] == "execute"] == [True, True, True, False]


def test_visible_macros_of_a_ring(spark, monkeypatch):
    monkeypatch.setattr(graph, "ancestors", None)
    monkeypatch.setattr(references, "ancestors", None, raising=False)  # pairs of files that reach each other are never made
    inc = spark.createDataFrame([(f"f{i}", f"f{(i + 1) % 12}") for i in range(12)] + [("g", "f3"), (None, "f1")], "file string, included string")
    mac = spark.createDataFrame([("f0", "M"), ("f7", "N"), ("f7", None), ("h", "M")], "file string, name string")
    want = {(f, n) for f in [f"f{i}" for i in range(12)] + ["g"] for n in ("M", "N", None)} | {("h", "M")}
    assert {(r.file, r.name) for r in references.visible_macros(inc, mac).collect()} == want


def test_visible_macros_of_a_popular_header(spark):
    """Each file that includes it has its name once, whatever the includes that are repeated, null or of itself."""
    n = 200
    inc = spark.createDataFrame([(f"f{i}", "hub") for i in range(n)] * 2 + [(f"g{i}", f"f{i}") for i in range(n)] + [("hub", "hub"), ("hub", None), (None, "hub")], "file string, included string")
    mac = spark.createDataFrame([("hub", "M"), ("hub", "M"), ("f7", "M")], "file string, name string")
    assert sorted((r.file, r.name) for r in references.visible_macros(inc, mac).collect()) == sorted((f, "M") for f in ["hub", *(f"{x}{i}" for x in "fg" for i in range(n))])


def test_leaves_without_cap(spark):
    chain = [(f"c{i + 1}", f"c{i}") for i in range(20)]  # c20 is on top
    pairs = [*chain, ("c3", "s"), ("x", "s"), ("s", "s"), ("o1", "o2"), ("o2", "o1"), ("o1", "t"), ("y", "t"), ("o2", "u")]
    start = spark.createDataFrame([("s",), ("t",), ("u",), ("x",), ("c0",), ("o1",)], "node string")
    got = {(r.start, r.leaf) for r in graph.leaves(start, edges(spark, pairs), cap=None).collect()}
    assert got == {("s", "c20"), ("s", "x"), ("t", "y"), ("x", "x"), ("c0", "c20")}  # circles without another caller have no leaf


def test_search_of_what_entries_reach(spark):
    pairs = [(f"n{i * 7 % 40}", f"n{i * 3 % 41}") for i in range(60)] + [("e", "n4"), ("n5", "e")]
    sinks = spark.createDataFrame([(i, f"n{i}") for i in range(0, 40, 2)] + [(99, "e"), (98, "far")], "sink int, node string")
    entries = spark.createDataFrame([("n1", True), ("n8", False), ("e", True), ("far", False)], "node string, definitive boolean")
    for depth in (1, 3, 20):
        whole, some = ({tuple(r) for r in graph.trace_to_entries(sinks, edges(spark, pairs), entries, depth, paths=False, ahead=a).collect()} for a in (False, True))
        assert whole == some and len(whole) > 2


def test_counts_before_joins(spark):
    """Calls meet counts of methods, and points at one place ask for their span once."""
    m = spark.createDataFrame([(i, f"f{i % 3}", "n", 1, "int") for i in range(9)] + [(20, "f9", "k", 0, "int")], "method_seq int, file string, name string, arity int, return_type string")
    c = spark.createDataFrame([(1, "f9", 9, 5, "n", 1, 3), (1, "f9", 9, 6, "k", 0, 4), (1, "f0", 9, 7, "n", 1, 4)], "sink int, sink_file string, sink_line int, call_seq int, callee string, arity int, line int")
    df = graph.unique_callees(c, m)
    assert [(r.method_seq, r.call_seq, r["rank"]) for r in df.collect()] == [(20, 6, 1)]
    joins = df._jdf.queryExecution().optimizedPlan().toString().split("Join ")
    assert "count(1)" in joins[-1]
    points = spark.createDataFrame([(i, "f", 5) for i in range(4)], "point int, file string, line int")
    spans = spark.createDataFrame([("f", 1, 9, "a", 1), ("f", 4, 6, "b", 2)], "file string, start int, end int, name string, seq int")
    df = graph.enclosing(points, spans)
    assert [r.name for r in df.collect()] == ["b"] * 4
    assert "Aggregate [file" in df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[-1]


def test_what_was_met_is_not_sorted(spark):
    """New rows are held by tasks and what was met streams by, as it lies."""
    seen = storage.Seen(["a", "b"])
    for i in range(3):
        seen.add(storage.cut(spark.range(i * 10, i * 10 + 10).selectExpr("id AS a", "'x' AS b"), by=["a", "b"]), 10)
    rows = spark.range(25, 35).selectExpr("id AS a", "'x' AS b", "id * 2 AS c").unionAll(spark.sql("SELECT CAST(NULL AS BIGINT), 'x', 1L"))
    new = seen.without(rows)
    assert {(r.a, r.c) for r in new.collect()} == {(None, 1), *((a, 2 * a) for a in range(30, 35))} and new.columns == rows.columns
    plan = new._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 3 and "SortMergeJoin" not in plan


def test_search_asks_edges_for_entries(spark):
    """An entry is not searched beyond, a hinted one is where it is the sink's own; an entry of two rows is proven if one is."""
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "a"), ("a", "e"), ("f", "e")], "caller string, callee string")
    entries = spark.createDataFrame([("c", False), ("c", True), ("d", True), ("f", False), ("a", False)], "node string, definitive boolean")
    got = graph.trace_to_entries(spark.createDataFrame([(1, "a"), (2, "c"), (3, "z")], "sink int, node string"), edges, entries)
    assert {(r.sink, r.entry, r.depth, tuple(r.path)) for r in got.collect()} == {(1, "c", 2, ("a", "b", "c")), (1, "f", 2, ("a", "e", "f")), (2, "c", 0, ("c",))}


def test_trace_shared(spark):
    """Nodes with the same callers are searched once: results as of the plain search, few pairs however many sinks."""
    r = random.Random(5)
    some = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(45)]
    wide = [(f"a{i}", f"b{j}") for i in range(12) for j in range(12)] + [(f"b{i}", f"s{i}") for i in range(12)] + [("top", f"a{i}") for i in range(12)]
    sinks = spark.createDataFrame([(f"S{i}", f"n{i}") for i in range(30)] + [("T", "n1"), ("T", "n2"), ("T", "n3")] + [(f"W{i}", f"s{i}") for i in range(12)], "sink string, node string")
    entries = spark.createDataFrame([("n1", True), ("n5", False), ("n8", False), ("n9", True), ("top", True), ("n3", False), ("a3", True)], "node string, definitive boolean")
    for pairs in (some + wide, some):
        e = spark.createDataFrame(pairs, "caller string, callee string")
        for depth in (2, 20):
            want = sorted(tuple(x) for x in graph.trace_to_entries(sinks, e, entries, depth, paths=False).collect())
            assert sorted(tuple(x) for x in graph.trace_shared(sinks, e, entries, depth).collect()) == want
    searched, plain = [], graph.trace_to_entries
    try:
        graph.trace_to_entries = lambda s, *a, **k: (searched.append(s.count()), plain(s, *a, **k))[1]
        graph.trace_shared(sinks.where("sink LIKE 'W%'"), spark.createDataFrame(wide, "caller string, callee string"), entries)
    finally:
        graph.trace_to_entries = plain
    assert searched == [1]


def test_shapes_of_calls_are_the_edges(spark):
    """Edges through what calls have in common are those of callers, from rows as many as calls and methods and not their pairs."""
    r = random.Random(8)
    owners = ["", "A", "B", "C", "D"]
    method = lambda i: (i, f"f{i % 3}", f"n{r.randrange(3)}", r.choice([-1, 0, 1]), o := r.choice(owners), f"p.{o}" if o and r.random() < 0.7 else "", r.choice([[], ["int"], ["std::string"], ["a", "b", "c", "d", "int"]]))
    call = lambda i: (1000 + i, f"n{r.randrange(3)}", r.choice([0, 1]), r.randrange(60), f"f{r.randrange(3)}", r.random() < 0.3, r.random() < 0.3, r.choice(["", "", "const B &"]), r.choice(["", "", "?R", "~B", "p.C", "p.D"]), r.choice([None, [], ["long"], ["char"], ["a", "b", "c", "d", "x"]]))
    kind = "method_seq int, file string, name string, arity int, owner string, qualified string, parameter_types array<string>"
    asks = "call_seq int, callee string, arity int, caller_seq int, file string, receiver_is_self boolean, implicit_self boolean, target_owner string, target_qualified string, argument_types array<string>"
    up = spark.createDataFrame([("B", "A"), ("C", "B"), ("C", "A")], "type string, ancestor string")
    full = spark.createDataFrame([("p.B", "p.A"), ("p.C", "p.B"), ("p.C", "p.A"), ("p.D", "?R")], "type string, ancestor string")
    tables = (spark.createDataFrame([method(i) for i in range(60)], kind), spark.createDataFrame([call(i) for i in range(300)], asks), up, full)
    every = [tuple(x) for x in typed.callers(*tables).select("method_seq", "call_seq", "caller_seq").collect()]
    want = {(m, k) for m, _, k in every}
    assert len(every) == len(set(every)) and len(want) > 200
    assert {(x.method_seq, x.caller_seq) for x in typed.callers(*tables, once=False).collect()} == want
    asked, met = typed.shapes(*tables)
    assert {(x.method_seq, x.caller_seq) for x in asked.join(met, "shape").collect()} == want
    many = (spark.createDataFrame([(i, "f", "run", 0, "", "", []) for i in range(200)], kind), spark.createDataFrame([(i, "run", 0, i, "f", False, False, "", "", []) for i in range(200)], asks), up, full)
    asked, met = typed.shapes(*many)
    assert asked.count() + met.count() == 400


def test_trace_through_shapes(spark):
    """Sinks over callers of shapes and what shapes reach, as over the pairs of both."""
    r = random.Random(11)
    asks = [(f"n{r.randrange(40)}", f"s{r.randrange(14)}") for _ in range(40)]
    meets = [(f"s{r.randrange(14)}", f"n{r.randrange(40)}") for _ in range(40)] + [("s99", "n1")]
    edges, through = spark.createDataFrame(asks, "caller string, callee string"), spark.createDataFrame(meets, "shape string, node string")
    sinks = spark.createDataFrame([(f"S{i}", f"n{i}") for i in range(40)] + [("T", "n2"), ("T", "n4")], "sink string, node string")
    entries = spark.createDataFrame([("n1", True), ("n5", False), ("n8", False), ("n9", True)], "node string, definitive boolean")
    pairs = spark.createDataFrame([(c, n) for c, s in asks for t, n in meets if s == t], "caller string, callee string")
    want = sorted(tuple(x) for x in graph.trace_to_entries(sinks, pairs, entries, 20, paths=False).collect())
    assert sorted(tuple(x) for x in graph.trace_shared(sinks, edges, entries, 20, through=through).collect()) == want and len(want) > 40


def test_trace_dense(spark, monkeypatch):
    """A row for many sinks: results as of the plain search, with several blocks, sinks at several nodes, and the last bit of a word."""
    r = random.Random(13)
    monkeypatch.setattr(graph, "WORDS", 1)
    edges = spark.createDataFrame([(r.randrange(50), r.randrange(50)) for _ in range(90)] + [(5, 5)], "caller long, callee long")
    sinks = spark.createDataFrame([(i, r.randrange(50)) for i in range(200)] + [(300, 1), (300, 2), (300, 3), (301, 999)], "sink long, node long")
    entries = spark.createDataFrame([(1, True), (5, False), (8, False), (9, True), (1, False), (20, False)], "node long, definitive boolean")
    want = sorted(tuple(x) for x in graph.trace_to_entries(sinks, edges, entries, 5, paths=False).collect())
    assert sorted(tuple(x) for x in graph.trace_dense(sinks, edges, entries, 5).select("sink", "entry", "depth").collect()) == want and want
    monkeypatch.setattr(graph, "WORDS", 8)
    rows, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="graph", *a, **k: (lambda t: (rows.append(t.count()) if name == "level" else None, t)[1])(cut(df, name, *a, **k)))
    full = spark.createDataFrame([(i, j) for i in range(30) for j in range(30)], "caller long, callee long")
    got = graph.trace_dense(spark.createDataFrame([(i, i % 30) for i in range(400)], "sink long, node long"), full, entries.where("node = 1"))
    assert got.count() == 400 and sum(rows) <= 60  # of 400 sinks at 30 nodes
