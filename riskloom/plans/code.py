"""Registered queries: typed call edges and searches, declarations in order, nested routes, normalised hits, report documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import cut
from ..operators import analytics as A
from ..operators import candidates as C
from ..operators import frontends as E
from ..operators import graph as G
from ..operators import references as R
from ..operators import reports as P
from ..operators import rules as Rules
from ..operators import session as N
from ..operators import typed as T
from ..operators import verify as L
from ..sources import bridge as B
from .queries import FINDINGS, MERGED, SCORED, STATS, findings, merged, scored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# --- typed edges -----------------------------------------------------------------------------------------------

_KINDS = ["int", "unsigned long", "const char *", "std::string", "const Foo &", "T", "", "ns::bar"]


def _kind(x):
    return F.get(F.array(*[F.lit(k) for k in _KINDS]), (x % 8).cast("int"))


def _short(x: str) -> str:
    return rf"regexp_replace(trim(regexp_replace({x}, '\b(const|volatile|signed|unsigned|struct|class|enum)\b|[*&\s]+', ' ', 'g')), '^.*::', '')"


def _typed(name: str, callee: str) -> str:
    """Methods, calls and their typed edges; name and callee: numbers of a part's method and of what an order calls."""
    return f"""m AS (SELECT p_partkey AS method_seq, 'n' || {name} AS name, CASE WHEN p_partkey % 13 = 0 THEN -1 ELSE p_partkey % 3 END AS arity, p_brand AS file, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'T' || p_size END AS owner,
  CASE WHEN p_partkey % 11 = 0 OR p_partkey % 17 = 0 THEN '' ELSE 'pk' || p_size % 3 || '.T' || p_size END AS qualified,
  CASE p_partkey % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [{_KINDS}[p_partkey % 8 + 1]] ELSE [{_KINDS}[p_partkey % 8 + 1], {_KINDS}[p_size % 8 + 1]] END AS params,
  CASE WHEN p_partkey % 7 = 0 THEN 'GET /' || p_partkey END AS entry_reason, p_partkey % 14 = 0 AS definitive, p_size % 5 = 0 AS is_sink FROM part),
c AS (SELECT o_orderkey AS call_seq, 'n' || {callee} AS callee, o_orderkey % 3 AS arity, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS caller_seq, 'Brand#' || o_orderkey % 25 + 1 AS file, o_orderkey % 10 < 2 AS self, o_orderkey % 10 IN (2, 3) AS implicit,
  CASE o_orderkey % 10 WHEN 4 THEN '?Runnable' WHEN 5 THEN '~T' || o_custkey % 50 + 1 WHEN 6 THEN 'pk' || (o_custkey % 50 + 1) % 3 || '.T' || o_custkey % 50 + 1 WHEN 7 THEN 'pk' || (o_custkey % 25 + 1) % 3 || '.T' || o_custkey % 25 + 1 ELSE '' END AS target_qualified,
  CASE WHEN o_orderkey % 10 = 8 THEN 'const std::T' || o_custkey % 50 + 1 || ' &' ELSE '' END AS target_owner,
  CASE o_orderkey % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [{_KINDS}[o_orderkey % 8 + 1]] ELSE [{_KINDS}[o_orderkey % 8 + 1], {_KINDS}[o_custkey % 8 + 1]] END AS args FROM orders),
up AS (SELECT DISTINCT p_size AS k, p_size // 2 AS u FROM part WHERE p_size >= 2),
e AS (SELECT 'T' || k AS type, 'T' || u AS ancestor FROM up UNION ALL SELECT 'pk' || k % 3 || '.T' || k, 'pk' || u % 3 || '.T' || u FROM up UNION ALL SELECT 'pk' || k % 3 || '.T' || k, '?Runnable' FROM up WHERE k % 7 = 0),
anc(type, ancestor) AS (SELECT type, ancestor FROM e UNION SELECT anc.type, e.ancestor FROM anc JOIN e ON e.type = anc.ancestor),
kin AS (SELECT type AS a, ancestor AS b FROM anc UNION SELECT ancestor, type FROM anc),
pairs AS (SELECT m.method_seq, c.call_seq, c.caller_seq, m.params, c.args FROM c JOIN m f ON f.method_seq = c.caller_seq JOIN m ON m.name = c.callee AND (m.arity = -1 OR m.arity = c.arity)
  WHERE (NOT c.self OR f.owner = '' OR m.owner = '' OR f.owner = m.owner OR EXISTS (SELECT 1 FROM kin WHERE kin.a = f.owner AND kin.b = m.owner))
  AND (c.target_owner = '' OR m.owner = '' OR {_short("c.target_owner")} = m.owner)
  AND CASE WHEN c.self OR c.implicit THEN f.qualified = '' OR m.qualified = '' OR (c.implicit AND m.file = c.file) OR f.qualified = m.qualified OR EXISTS (SELECT 1 FROM kin WHERE kin.a = f.qualified AND kin.b = m.qualified)
    WHEN c.target_qualified = '' OR m.qualified = '' THEN true
    WHEN c.target_qualified[1] = '?' THEN EXISTS (SELECT 1 FROM anc WHERE anc.type = m.qualified AND anc.ancestor = c.target_qualified)
    WHEN c.target_qualified[1] = '~' THEN m.owner = '' OR m.owner = substr(c.target_qualified, 2) OR EXISTS (SELECT 1 FROM kin WHERE kin.a = m.owner AND kin.b = substr(c.target_qualified, 2))
    ELSE c.target_qualified = m.qualified OR EXISTS (SELECT 1 FROM kin WHERE kin.a = m.qualified AND kin.b = c.target_qualified) END),
args AS (SELECT method_seq, call_seq, {_short("a")} AS a, {_short("p")} AS p FROM (SELECT method_seq, call_seq, unnest(args) AS a, unnest(params) AS p FROM pairs WHERE len(args) = len(params))),
wrong AS (SELECT DISTINCT method_seq, call_seq FROM args WHERE NOT (a = '' OR p = '' OR a = p OR regexp_full_match(p, '[A-Z]\\w*') OR (list_contains({R.NUMERIC}, a) AND list_contains({R.NUMERIC}, p)) OR (list_contains({R.STRINGS}, a) AND list_contains({R.STRINGS}, p)))),
typed AS (SELECT p.method_seq, p.call_seq, p.caller_seq FROM pairs p ANTI JOIN wrong w ON w.method_seq = p.method_seq AND w.call_seq = p.call_seq)"""


_TYPED = _typed("p_partkey // 2", "o_custkey * 2 // 3 + o_orderkey % 3")
#: Names that many methods share, in every table as many.
_COMMON = _typed("p_partkey % 97", "o_custkey % 97")


def _typed_tables(spark, sf_dir, common: bool = False):
    p, size, o, k = F.col("p_partkey"), F.col("p_size"), F.col("o_orderkey"), F.col("o_custkey")
    qualified = lambda x: F.concat(F.lit("pk"), x % 3, F.lit(".T"), x)
    none = F.array().cast("array<string>")
    methods = B.table(spark, sf_dir, "part").select(
        p.alias("method_seq"), F.concat(F.lit("n"), p % 97 if common else F.floor(p / 2)).alias("name"), F.when(p % 13 == 0, -1).otherwise(p % 3).alias("arity"), F.col("p_brand").alias("file"),
        F.when(p % 11 == 0, "").otherwise(F.concat(F.lit("T"), size)).alias("owner"), F.when((p % 11 == 0) | (p % 17 == 0), "").otherwise(qualified(size)).alias("qualified"),
        F.when(p % 3 == 0, none).when(p % 3 == 1, F.array(_kind(p))).otherwise(F.array(_kind(p), _kind(size))).alias("parameter_types"),
        F.when(p % 7 == 0, F.concat(F.lit("GET /"), p)).alias("entry_reason"), (p % 14 == 0).alias("definitive"), (size % 5 == 0).alias("is_sink"),
    )
    way, near = o % 10, k % 50 + 1
    target = F.when(way == 4, "?Runnable").when(way == 5, F.concat(F.lit("~T"), near)).when(way == 6, qualified(near)).when(way == 7, qualified(k % 25 + 1)).otherwise("")
    calls = B.table(spark, sf_dir, "orders").select(
        o.alias("call_seq"), F.concat(F.lit("n"), k % 97 if common else F.floor(k * 2 / 3) + o % 3).alias("callee"), (o % 3).alias("arity"), F.when(o % 11 != 0, k).alias("caller_seq"), F.concat(F.lit("Brand#"), o % 25 + 1).alias("file"),
        (way < 2).alias("receiver_is_self"), way.isin(2, 3).alias("implicit_self"), target.alias("target_qualified"), F.when(way == 8, F.concat(F.lit("const std::T"), near, F.lit(" &"))).otherwise("").alias("target_owner"),
        F.when(o % 3 == 0, none).when(o % 3 == 1, F.array(_kind(o))).otherwise(F.array(_kind(o), _kind(k))).alias("argument_types"),
    )
    up = B.table(spark, sf_dir, "part").where("p_size >= 2").select(F.col("p_size").alias("k"), F.floor(F.col("p_size") / 2).alias("u")).distinct()
    bare = up.select(F.concat(F.lit("T"), "k").alias("type"), F.concat(F.lit("T"), "u").alias("parent"))
    full = up.select(qualified(F.col("k")).alias("type"), qualified(F.col("u")).alias("parent")).unionAll(up.where("k % 7 = 0").select(qualified(F.col("k")), F.lit("?Runnable")))
    above = G.ancestors(bare.unionAll(full))  # names of the two kinds differ, and one closure serves both
    return methods, calls, above.where("type LIKE 'T%'"), above.where("type LIKE 'pk%'")


@query(f"WITH RECURSIVE {_TYPED} SELECT method_seq, call_seq, caller_seq FROM typed")
def callers_typed(spark, sf_dir):
    return T.callers(*_typed_tables(spark, sf_dir))


@query(f"""WITH RECURSIVE {_COMMON},
k AS (SELECT method_seq, concat_ws('|', file, owner, name, arity, array_to_string(params, ',')) AS node FROM m),
ent AS (SELECT k.node, bool_or(m.definitive) AS definitive FROM m JOIN k ON k.method_seq = m.method_seq WHERE m.entry_reason IS NOT NULL GROUP BY k.node),
ed AS (SELECT DISTINCT a.node AS caller, b.node AS callee FROM typed t JOIN k a ON a.method_seq = t.caller_seq JOIN k b ON b.method_seq = t.method_seq),
st AS (SELECT DISTINCT m.method_seq AS sink, k.node, ent.definitive FROM m JOIN k ON k.method_seq = m.method_seq LEFT JOIN ent ON ent.node = k.node WHERE m.is_sink),
r(sink, node, depth) USING KEY (sink, node) AS (SELECT sink, node, 0 FROM st UNION SELECT r.sink, ed.caller, min(r.depth) + 1 FROM r JOIN ed ON ed.callee = r.node LEFT JOIN ent ON ent.node = r.node
  WHERE r.depth < 20 AND (ent.node IS NULL OR (r.depth = 0 AND NOT ent.definitive)) AND NOT EXISTS (SELECT 1 FROM recurring.r v WHERE v.sink = r.sink AND v.node = ed.caller) GROUP BY r.sink, ed.caller),
best AS (SELECT sink, node, min(depth) AS depth FROM r GROUP BY sink, node),
found AS (SELECT b.sink, b.node AS entry, b.depth FROM best b JOIN ent ON ent.node = b.node WHERE b.depth > 0 OR ent.definitive)
SELECT sink, entry, depth FROM found UNION ALL SELECT s.sink, s.node, 0 FROM st s WHERE NOT s.definitive AND s.sink NOT IN (SELECT sink FROM found)""")
def trace_typed(spark, sf_dir):
    """Entries of sinks over typed edges; methods that agree in file, owner, name, arity and parameters are one node.  Names are common ones,
    so that types decide."""
    methods, calls, bare, full = _typed_tables(spark, sf_dir, common=True)
    methods = methods.withColumn("node", F.concat_ws("|", "file", "owner", "name", "arity", F.array_join("parameter_types", ",")))
    edges = T.callers(methods, calls, bare, full, once=False)
    # nodes are numbers while edges are made and searched
    nodes = cut(methods.groupBy("node").agg(F.min("method_seq").alias("id")), "nodes")
    named = cut(methods.join(nodes, "node").select("method_seq", "id", "is_sink", "entry_reason", "definitive"), "named")
    edges = edges.join(named.select("method_seq", F.col("id").alias("callee")), "method_seq").join(named.select(F.col("method_seq").alias("caller_seq"), F.col("id").alias("caller")), "caller_seq")
    sinks = named.where("is_sink").select(F.col("method_seq").alias("sink"), F.col("id").alias("node"))
    found = G.trace_dense(sinks, edges.select("caller", "callee"), named.where("entry_reason IS NOT NULL").select(F.col("id").alias("node"), "definitive"))
    return found.join(nodes.withColumnRenamed("id", "entry"), "entry").select("sink", F.col("node").alias("entry"), "depth")


# --- declarations ----------------------------------------------------------------------------------------------


@query("SELECT p_brand, p_size, CASE WHEN count(DISTINCT t) = 1 AND count(t) = count(*) THEN max(t) END AS form FROM (SELECT p_brand, p_size, CASE WHEN p_partkey % 50 > 0 THEN 'f' || p_partkey // 7 % 2 END AS t FROM part) GROUP BY p_brand, p_size")
def only_form(spark, sf_dir):
    p = F.col("p_partkey")
    df = B.table(spark, sf_dir, "part").select("p_brand", "p_size", F.when(p % 50 > 0, F.concat(F.lit("f"), F.floor(p / 7) % 2)).alias("form"))
    return R.only_form(df, ["p_brand", "p_size"], "form")


@query("""WITH RECURSIVE inc AS (SELECT 'f' || s_suppkey AS file, 'f' || (s_suppkey * 7 + s_nationkey) % 120 AS included FROM supplier), mac AS (SELECT 'f' || s_suppkey AS file, 'M' || s_nationkey AS name FROM supplier WHERE s_suppkey % 3 = 0),
r(file, here) AS (SELECT file, included FROM inc UNION SELECT r.file, inc.included FROM r JOIN inc ON inc.file = r.here) SELECT file, name FROM mac UNION SELECT r.file, mac.name FROM r JOIN mac ON mac.file = r.here""")
def visible_macros(spark, sf_dir):
    s = F.col("s_suppkey")
    supplier = B.table(spark, sf_dir, "supplier")
    includes = supplier.select(F.concat(F.lit("f"), s).alias("file"), F.concat(F.lit("f"), (s * 7 + F.col("s_nationkey")) % 120).alias("included"))
    return R.visible_macros(includes, supplier.where("s_suppkey % 3 = 0").select(F.concat(F.lit("f"), s).alias("file"), F.concat(F.lit("M"), "s_nationkey").alias("name")))


@query("""WITH i AS (SELECT user_id AS body, event_id AS pos, CASE event_type WHEN 'view' THEN 'mark' WHEN 'click' THEN 'mark' WHEN 'signup' THEN 'other' ELSE 'method' END AS kind, event_type || event_id AS name FROM events),
g AS (SELECT *, coalesce(sum(CASE WHEN kind <> 'mark' THEN 1 ELSE 0 END) OVER (PARTITION BY body ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isl FROM i),
k AS (SELECT body, isl, string_agg(name, ',' ORDER BY pos) AS marks FROM g WHERE kind = 'mark' GROUP BY body, isl)
SELECT g.body, g.pos, g.kind, g.name, CASE WHEN g.kind = 'method' THEN coalesce(k.marks, '') ELSE '' END AS marks FROM g LEFT JOIN k ON k.body = g.body AND k.isl = g.isl WHERE g.kind <> 'mark'""")
def pending_marks(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), "mark").when(F.col("event_type") == "signup", "other").otherwise("method")
    items = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("body"), F.col("event_id").alias("pos"), kind.alias("kind"), F.concat("event_type", "event_id").alias("name"))
    return R.attach_pending(items).withColumn("marks", F.array_join("marks", ","))


@query("""WITH RECURSIVE b AS (SELECT c_custkey AS block, CASE WHEN c_custkey % 9 > 0 THEN c_custkey // 2 END AS parent, CASE WHEN c_custkey % 10 > 0 THEN '/' || c_nationkey END AS segment FROM customer),
r(block, here, route) AS (SELECT block, parent, coalesce(segment, '') FROM b UNION ALL SELECT r.block, b.parent, coalesce(b.segment, '') || r.route FROM r JOIN b ON b.block = r.here)
SELECT block, route FROM r WHERE here IS NULL OR here NOT IN (SELECT block FROM b)""")
def route_prefixes(spark, sf_dir):
    k = F.col("c_custkey")
    blocks = B.table(spark, sf_dir, "customer").select(k.alias("block"), F.when(k % 9 > 0, F.floor(k / 2)).alias("parent"), F.when(k % 10 > 0, F.concat(F.lit("/"), "c_nationkey")).alias("segment"))
    return R.route_prefixes(blocks)


# --- candidates ------------------------------------------------------------------------------------------------

_TRACE = """CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '{"taint_source": ["CliLoc", [{"path": "/work/' || file || '", "start": {"line": ' || line_no + 1 || '}}, "v"]]}'
  WHEN 2 THEN '{"taint_source": ["CliLoc", [{"path": "/work/other/' || file || '", "start": {"line": 3}}, "v"]]}' WHEN 3 THEN '{"taint_source": ["CliLoc", []]}' WHEN 4 THEN '{"taint_source": "x"}' WHEN 5 THEN '{broken' ELSE '{"taint_sink": []}' END"""


@query(f"""WITH {MERGED},
raw AS (SELECT h.doc_id, h.rule_id, h.file, h.line_no, h.severity, {_TRACE} AS trace FROM raw_hits h),
n AS (SELECT *, CASE doc_id % 7 WHEN 1 THEN line_no + 1 WHEN 2 THEN 3 ELSE line_no END AS source_line, CASE WHEN doc_id % 7 = 2 THEN 'other/' || file ELSE file END AS source_file FROM raw)
SELECT n.doc_id, n.rule_id, n.severity, n.source_file, n.source_line, n.file AS sink_file, n.line_no AS sink_line, n.source_file = n.file AS is_intraprocedural, sha256(n.source_file || ':' || n.source_line || ':' || n.file || ':' || n.line_no) AS dedup_key,
  CASE n.rule_id WHEN 'email' THEN 'said' ELSE 'found ' || n.rule_id END AS message, substr(d.text, n.doc_id % 40 + 1, 17) AS code_snippet FROM n JOIN documents d ON d.doc_id = n.doc_id
  WHERE NOT (n.rule_id = 'ipv4' AND n.doc_id % 5 = 0)""")
def normalized_hits(spark, sf_dir):
    """Raw hits of a scan below /work with traces of every shape, C++ rules in headers, and a validator's own message."""
    d, line = F.col("doc_id"), F.col("line_no").cast("string")
    place = lambda before, file, n: F.concat(F.lit('{"taint_source": ["CliLoc", [{"path": "/work/' + before), file, F.lit('", "start": {"line": '), n, F.lit('}}, "v"]]}'))
    file = F.col("file")
    shapes = [F.lit(None).cast("string"), place("", file, (F.col("line_no") + 1).cast("string")), place("other/", file, F.lit("3")), F.lit('{"taint_source": ["CliLoc", []]}'), F.lit('{"taint_source": "x"}'), F.lit("{broken"), F.lit('{"taint_sink": []}')]
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.substr("text", F.lit(1), (d % 40).cast("int"))).alias("a"), F.octet_length(F.substr("text", F.lit(1), (d % 40 + 17).cast("int"))).alias("e"))
    hits = B.raw_hits(spark, sf_dir).join(docs, "doc_id")
    # a C++ rule and a header's name stand for one rule, so that the header guard has something to drop
    cpp = F.col("rule_id") == "ipv4"
    raw = hits.select(
        "doc_id", F.col("rule_id").alias("check_id"), F.concat(F.lit("/work/"), file, F.when(cpp, ".h").otherwise("")).alias("path"), F.struct(F.col("line_no").alias("line"), F.col("a").alias("offset")).alias("start"), F.struct(F.col("line_no").alias("line"), F.col("e").alias("offset")).alias("end"),
        F.struct(F.concat(F.lit(" found "), "rule_id", F.lit("\n")).alias("message"), "severity", F.struct("cwe", F.when(cpp, "cpp").alias("language"), "confidence").alias("metadata"), F.get(F.array(*shapes), (d % 7).cast("int")).alias("dataflow_trace")).alias("extra"),
    )
    texts = B.table(spark, sf_dir, "documents").select(B.file_name().alias("f"), "doc_id", F.col("text").cast("binary").alias("content"))
    files = texts.select(F.col("f").alias("file"), "content", F.lit(False).alias("is_cpp")).unionAll(texts.select(F.concat("f", F.lit(".h")), "content", F.col("doc_id") % 5 > 0))
    said = hits.where("rule_id = 'email'").select("rule_id", "file", F.col("line_no").alias("line"), F.lit("said").alias("message"), F.lit("HIGH").alias("rule_confidence"), F.lit("{}").alias("static_analysis")).distinct()
    out = C.normalize(raw, "/work", files, said)
    bare = lambda c: F.regexp_replace(c, r"\.h$", "")
    out = out.withColumn("sink_file", bare("sink_file")).withColumn("source_file", bare("source_file")).withColumn("dedup_key", C.dedup_key())
    out = out.withColumn("is_intraprocedural", F.col("source_file") == F.col("sink_file")).withColumn("doc_id", F.regexp_extract("sink_file", r"/d(\d+)\.txt$", 1).cast("long"))
    return out.select("doc_id", "rule_id", "severity", "source_file", "source_line", "sink_file", "sink_line", "is_intraprocedural", "dedup_key", "message", "code_snippet")


@query(f"WITH {FINDINGS} SELECT dedup_key, reachable, sink_file FROM finding UNION ALL SELECT dedup_key, NULL, sink_file FROM scoped")
def appended_candidates(spark, sf_dir):
    found = findings(spark, sf_dir).select("dedup_key", F.col("finding.reachable").alias("reachable"), "sink_file")
    more = C.drop_out_of_scope(B.candidates(spark, sf_dir), B.OUT_OF_SCOPE).withColumn("dedup_key", C.dedup_key()).select("dedup_key", "sink_file")
    return C.with_candidates(found, more)


@query(f"WITH {MERGED} SELECT dedup_key FROM merged ORDER BY doc_id, line_no, rule_id LIMIT 100")
def first_candidates(spark, sf_dir):
    return C.first_candidates(merged(spark, sf_dir), 100).select("dedup_key")


@query(r"""WITH t AS (SELECT conv_id, turn, concat_ws(' ', coalesce(text, ''), CASE WHEN turn % 3 = 0 THEN repeat('漏洞', CAST(conv_id % 60 AS INTEGER)) ELSE '' END, role) AS x FROM conversations),
c AS (SELECT conv_id, turn, len(regexp_extract_all(x, '[\x{4e00}-\x{9fff}]')) AS h, len(regexp_extract_all(x, '[A-Za-z]')) AS l FROM t)
SELECT conv_id, turn, CASE WHEN h + l > 0 AND h / (h + l) >= 0.15 THEN 'zh' ELSE 'en' END AS language FROM c""")
def finding_language(spark, sf_dir):
    more = F.when(F.col("turn") % 3 == 0, F.repeat(F.lit("漏洞"), (F.col("conv_id") % 60).cast("int"))).otherwise("")
    df = B.table(spark, sf_dir, "conversations").withColumn("finding", F.struct(F.col("text").alias("reasoning"), more.alias("exploit_scenario"), F.col("role").alias("remediation")))
    return df.select("conv_id", "turn", L.finding_language().alias("language"))


# --- reports ---------------------------------------------------------------------------------------------------


def _reported(spark, sf_dir):
    """Scored findings with texts that need escaping, some of them translated."""
    df = scored(spark, sf_dir)
    zh = F.when(F.col("doc_id") % 3 == 0, F.lit("标签 <b>"))
    finding = F.when(F.col("finding").isNotNull(), F.struct(F.col("finding.reachable").alias("reachable"), F.col("finding.reasoning").alias("reasoning"), zh.alias("reasoning_zh"), F.concat(F.lit("see <a href='"), "rule_id", F.lit("'>\n & more")).alias("remediation"), F.lit(70).alias("confidence")))
    return df.withColumn("finding", finding)


_REASON = "CASE WHEN reachable IS NULL THEN '' WHEN doc_id % 17 = 0 THEN 'verifier_failed: no reply' ELSE 'label' END"
_NUMBERED = f"{SCORED},\nnum AS (SELECT *, row_number() OVER (PARTITION BY report_id, risk_level ORDER BY sink_file, sink_line) AS n, list_position(['critical', 'high', 'medium', 'low'], risk_level) AS section, {_REASON} AS reasoning FROM scored)"


@query(f"""WITH {_NUMBERED},
tot AS (SELECT report_id, count(*) AS t, count(*) FILTER (WHERE verdict = 'yes') AS y, count(*) FILTER (WHERE verdict = 'no') AS s FROM scored GROUP BY report_id),
head AS (SELECT report_id, unnest(['# Findings: ' || report_id, '', '| Total | Reachable | Not reachable | To review |', '| --- | --- | --- | --- |', '| ' || t || ' | ' || y || ' | ' || s || ' | ' || t - y - s || ' |', '']) AS text, unnest(range(0, 6)) AS part FROM tot),
each AS (SELECT report_id, section, n, unnest(['### ' || n || '. ' || vuln_type || ' - `' || sink_file || ':' || sink_line || '`', '', '- **Source** `' || sink_file || ':' || sink_line || '`', '- **Score** ' || printf('%.1f', cvss_score) || ' (`CVSS:3.1/' || cvss_vector || '`)',
  '- **Class** ' || cwe[1], '- **Rule** ' || array_to_string(messages, ' / '), CASE WHEN reachable IS NOT NULL THEN '- **Confidence** 70' END, NULL, CASE WHEN reasoning <> '' THEN '- **Why** ' || reasoning END, NULL,
  CASE WHEN reachable IS NOT NULL THEN '- **Fix** see <a href=''' || rule_id || '''> & more' END, '']) AS text, unnest(range(0, 12)) AS part FROM num)
SELECT report_id, 0 AS section, 0 AS place, part, text FROM head UNION ALL
SELECT report_id, section, 0, 0, '## ' || upper(risk_level[1]) || risk_level[2:] || ' (' || count(*) || ')' FROM num GROUP BY report_id, section, risk_level UNION ALL
SELECT report_id, section, n, part, text FROM each WHERE text IS NOT NULL""")
def report_markdown(spark, sf_dir):
    return P.markdown(_reported(spark, sf_dir)).select("report_id", "section", "place", "part", "text")


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""WITH {_NUMBERED}, x AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '标签 <b>' ELSE reasoning END AS zh, trim('see <a href=''' || rule_id || '''>' || chr(10) || ' & more') AS fix FROM num)
SELECT report_id, section, n AS place, '<details class="' || risk_level || '" data-verdict="' || verdict || '"><summary title="' || {_ESC.format("sink_file || ':' || sink_line")} || '">' || {_ESC.format("vuln_type")} || ' <b>' || printf('%.1f', cvss_score) || '</b> <code>.../' || string_split(sink_file, '/')[-2] || '/' || string_split(sink_file, '/')[-1] || ':' || sink_line || '</code></summary><p>'
  || {_ESC.format("array_to_string(messages, ' / ')")} || '</p>' || CASE WHEN reasoning <> '' THEN '<p class="reasoning" data-zh="' || {_ESC.format("zh")} || '" data-en="' || {_ESC.format("reasoning")} || '">' || {_ESC.format("reasoning")} || '</p>' ELSE '' END
  || CASE WHEN reachable IS NOT NULL THEN '<p class="remediation" data-zh="' || {_ESC.format("fix")} || '" data-en="' || {_ESC.format("fix")} || '">' || {_ESC.format("fix")} || '</p>' ELSE '' END || '</details>' AS text FROM x""")
def report_cards(spark, sf_dir):
    return P.html_cards(_reported(spark, sf_dir)).select("report_id", "section", "place", "text")


@query(f"""WITH {SCORED}, f AS (SELECT report_id, place, name, value, count(*) AS n FROM (SELECT report_id, 1 AS place, 'type' AS name, vuln_type AS value FROM scored UNION ALL SELECT report_id, 2, 'file', sink_file FROM scored UNION ALL SELECT report_id, 3, 'severity', risk_level FROM scored) GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY report_id, place ORDER BY CASE WHEN place = 3 THEN list_position(['critical', 'high', 'medium', 'low'], value) ELSE -n END, value) AS nth FROM f),
h AS (SELECT report_id, place, name, sum(n) AS n, max(nth) AS last FROM g GROUP BY ALL),
s AS (SELECT report_id, count(*) AS total, count(*) FILTER (WHERE verdict = 'yes') AS reachable, count(*) FILTER (WHERE verdict = 'no') AS safe, count(*) FILTER (WHERE verdict NOT IN ('yes', 'no')) AS review FROM scored GROUP BY report_id)
SELECT report_id, 0 AS section, place, nth AS part, '<button class="facet' || CASE WHEN place = 2 AND nth > 5 THEN ' late' ELSE '' END || '" data-facet="' || name || '" data-value="' || {_ESC.format("value")} || '">' || {_ESC.format("CASE WHEN place = 2 THEN string_split(value, '/')[-1] ELSE value END")} || ' (' || n || ')</button>' AS text FROM g
UNION ALL SELECT report_id, 0, place, 0, '<div class="facets" data-facet="' || name || '"><button class="facet" data-value="">all (' || n || ')</button>' FROM h
UNION ALL SELECT report_id, 0, place, last + 1, CASE WHEN place = 2 AND last > 5 THEN '<button class="show-late">+' || last - 5 || '</button>' ELSE '' END || '</div>' FROM h
UNION ALL SELECT report_id, 0, 0, v.i, '<div class="stat ' || v.c || '">' || CASE v.i WHEN 1 THEN total WHEN 2 THEN reachable WHEN 3 THEN safe ELSE review END || '</div>' FROM s, (VALUES (1, 'total'), (2, 'reachable'), (3, 'safe'), (4, 'review')) v(i, c)""")
def report_facets(spark, sf_dir):
    """Tiles and facet columns of each report's page."""
    return P.html_facets(scored(spark, sf_dir)).select("report_id", "section", "place", "part", "text")


# --- source code: what the front ends find in texts made of the parts, against the parts themselves ------------------

_CODE = """p AS (SELECT p_partkey AS p, p_partkey % 2 = 0 AS java, CASE WHEN p_partkey % 2 = 0 THEN 'shop/C' || p_partkey || '.java' ELSE 'web/p' || p_partkey || '.py' END AS file FROM part),
cm AS (SELECT p, java, 'm' AS kind, file, 'm' || p % 97 AS name, 2 AS arity, CASE WHEN java THEN 7 WHEN p % 5 = 0 THEN 2 ELSE 3 END AS start_line, CASE WHEN java THEN 9 ELSE 4 END AS end_line,
  CASE WHEN p % 5 = 0 THEN CASE WHEN java THEN '@GetMapping' ELSE '@route /y' || p END END AS entry_reason FROM p
  UNION ALL SELECT p, java, 'n', file, 'n' || p % 89, 1, CASE WHEN java THEN 10 ELSE 5 END, CASE WHEN java THEN 13 ELSE 7 END, NULL FROM p)"""


@query(f"WITH {_CODE} SELECT CASE WHEN java THEN 'java' ELSE 'python' END AS lang, file, name, arity, CASE WHEN java THEN 'C' ELSE 'P' END || p AS owner, start_line, end_line, entry_reason, entry_reason IS NOT NULL AS definitive FROM cm")
def code_index(spark, sf_dir):
    rows = cut(E.extract(B.source_files(spark, sf_dir)).where("kind IN ('method', 'reference')"), "rows")  # read three times, parsed once
    return E.linked_entries(rows).select("lang", "file", "name", "arity", "owner", "start_line", "end_line", "entry_reason", "definitive")


@query(f"WITH {_CODE} SELECT file, CASE WHEN java THEN 12 ELSE 7 END AS line, CASE WHEN java THEN 'spel-injection-inline-parser' ELSE 'sql-string-built-from-nonconstant-segment' END AS rule_id, 'WARNING' AS severity, 'dataflow' AS mode FROM p")
def code_rules(spark, sf_dir):
    return Rules.match(Rules.call_sites(B.source_files(spark, sf_dir))).select("file", "line", "rule_id", "severity", "mode")


@query(f"""WITH RECURSIVE {_CODE},
up(p, a) AS (SELECT p, p // 2 FROM p WHERE java UNION SELECT up.p, q.p // 2 FROM up JOIN p q ON q.p = up.a AND q.java),
ed AS (SELECT a.p || 'm' AS caller, b.p || 'n' AS callee FROM p a JOIN p b ON a.p % 89 = b.p % 89 AND a.java = b.java WHERE a.p = b.p OR (a.java AND (EXISTS (SELECT 1 FROM up WHERE up.p = a.p AND up.a = b.p) OR EXISTS (SELECT 1 FROM up WHERE up.p = b.p AND up.a = a.p)))
  UNION SELECT a.p || 'n', b.p || 'm' FROM p a JOIN p b ON a.p * 7 % 97 = b.p % 97 WHERE NOT a.java OR NOT b.java OR a.p * 7 % 97 = b.p OR EXISTS (SELECT 1 FROM up WHERE up.p = b.p AND up.a = a.p * 7 % 97)),
r(sink, node, depth) USING KEY (sink, node) AS (SELECT p, p || 'n', 0 FROM p UNION SELECT r.sink, ed.caller, min(r.depth) + 1 FROM r JOIN ed ON ed.callee = r.node
  WHERE r.depth < 20 AND r.node NOT IN (SELECT p || 'm' FROM p WHERE p % 5 = 0) AND NOT EXISTS (SELECT 1 FROM recurring.r v WHERE v.sink = r.sink AND v.node = ed.caller) GROUP BY r.sink, ed.caller),
best AS (SELECT sink, node, min(depth) AS depth FROM r GROUP BY sink, node)
SELECT s.file AS sink, e.file || ':' || e.name AS entry, b.depth FROM best b JOIN p s ON s.p = b.sink JOIN cm e ON e.p || e.kind = b.node AND e.entry_reason IS NOT NULL""")
def code_trace(spark, sf_dir):
    """Rule hits with the entries that reach the methods around them, searched once a class of methods that are called alike, over shapes of calls; methods that agree
    in file, owner, name, arity and parameter types are one node."""
    files = B.source_files(spark, sf_dir)
    rows = cut(E.extract(files), "rows")
    key = T.node_key("file", "owner", "name", "arity", "parameter_types")
    methods = cut(E.linked_entries(rows).withColumn("node", key), "methods")
    hits = Rules.match(Rules.call_sites(files)).select("file", "line", "rule_id")
    spans = methods.select("file", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("node").alias("name"), F.col("id").alias("seq"))
    points = hits.select(F.struct("file", "line", "rule_id").alias("point"), "file", "line")
    sinks = G.enclosing(points, spans).where("name IS NOT NULL").select(F.col("point.file").alias("sink"), F.col("name").alias("node"))
    named = methods.select("id", "node")
    asked, met = E.call_shapes(rows)
    edges = asked.join(named.select(F.col("id").alias("caller"), F.col("node").alias("from")), "caller").select(F.col("from").alias("caller"), F.col("shape").alias("callee"))
    through = met.join(named.withColumnRenamed("id", "callee"), "callee").select("shape", "node")
    shown = methods.groupBy(F.col("node").alias("entry")).agg(F.min(F.concat_ws(":", "file", "name")).alias("shown"))
    found = G.trace_shared(sinks, edges, methods.where("entry_reason IS NOT NULL").select("node", "definitive"), named=shown, through=through)
    return found.select("sink", F.col("shown").alias("entry"), "depth")


# --- sessions, listings ----------------------------------------------------------------------------------------

_FLOW = ["signup", "view", "click", "purchase"]


@query("""WITH e AS (SELECT user_id AS scan_id, event_id AS seq, CASE WHEN event_type = 'error' AND event_id % 40 = 0 THEN 'failed' WHEN event_type = 'error' THEN 'paused' ELSE event_type END AS status FROM events),
b AS (SELECT *, lag(status) OVER (PARTITION BY scan_id ORDER BY seq) AS before FROM e), l AS (SELECT ['signup', 'view', 'click', 'purchase'] AS f)
SELECT seq, before, status, NOT coalesce(before IN ('done', 'failed', 'cancelled'), false) AND (before IS NULL OR status IN ('paused', 'done', 'failed', 'cancelled')
  OR (coalesce(list_position(f, status), 0) > 0 AND (coalesce(list_position(f, before), 0) = 0 OR list_position(f, status) >= list_position(f, before)))) AS allowed FROM b, l""")
def status_transitions(spark, sf_dir):
    status = F.when((F.col("event_type") == "error") & (F.col("event_id") % 40 == 0), "failed").when(F.col("event_type") == "error", "paused").otherwise(F.col("event_type"))
    events = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("seq"), status.alias("status"))
    return N.transitions(events, _FLOW).select("seq", "before", "status", "allowed")


@query("SELECT page_id FROM pages WHERE length(url) >= 30 AND NOT list_has_any(string_split(url, '/')[1:-2], ['en', 'fr'])")
def long_paths(spark, sf_dir):
    return N.long_paths(B.table(spark, sf_dir, "pages"), ["en", "fr"], 30, "url").select("page_id")


@query("SELECT doc_id FROM (SELECT doc_id, 'u' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.ZIP' ELSE '.tar' END AS path, n_chars * 50000 AS size FROM documents) WHERE lower(path) LIKE '%.zip' AND size <= 209715200")
def accepted_uploads(spark, sf_dir):
    d = F.col("doc_id")
    path = F.concat(F.lit("u"), d, F.when(d % 3 == 0, ".zip").when(d % 3 == 1, ".ZIP").otherwise(".tar"))
    return B.table(spark, sf_dir, "documents").where(N.accepted_upload(path, F.col("n_chars") * 50000)).select("doc_id")


@query(f"""WITH {STATS}, w AS (SELECT greatest(max(length(rule)), 4) AS a, greatest(max(length(hits::VARCHAR)), 4) AS b, greatest(max(length(yes::VARCHAR)), 3) AS c FROM stats)
SELECT row_number() OVER (ORDER BY hits DESC, rule) AS line, rtrim(rpad(rule, w.a::INT, ' ') || '  ' || lpad(hits::VARCHAR, w.b::INT, ' ') || '  ' || lpad(yes::VARCHAR, w.c::INT, ' ')) AS text FROM stats, w
UNION ALL SELECT 0, rpad('rule', w.a::INT, ' ') || '  ' || lpad('hits', w.b::INT, ' ') || '  ' || lpad('yes', w.c::INT, ' ') FROM w""")
def stats_table(spark, sf_dir):
    return N.text_table(cut(A.rule_stats(findings(spark, sf_dir))), [F.negate("hits"), F.col("rule")], ["rule", "hits", "yes"])


@query("""WITH meth AS (SELECT p_partkey AS method_seq, p_brand AS file, 'n' || p_size AS name, p_partkey % 40 + 1 AS s, p_partkey % 40 + 10 AS e, CASE WHEN p_partkey % 7 = 0 THEN 'old' END AS entry_reason, p_partkey % 14 = 0 AS definitive FROM part),
ent AS (SELECT p_brand AS file, 'n' || p_size AS name, p_partkey % 40 + 1 AS s, p_partkey % 40 + 10 - p_partkey % 2 AS e, min('POST /' || p_partkey) AS reason FROM part WHERE p_partkey % 5 = 0 GROUP BY 1, 2, 3, 4),
new AS (SELECT * FROM ent ANTI JOIN meth ON meth.file = ent.file AND meth.name = ent.name AND meth.s = ent.s AND meth.e = ent.e),
call AS (SELECT o_orderkey AS call_seq, 'Brand#' || o_orderkey % 25 + 1 AS file, o_orderkey % 50 AS line, o_custkey AS caller_seq FROM orders),
best AS (SELECT c.call_seq, min(n.e - n.s) AS w FROM call c JOIN new n ON n.file = c.file AND c.line BETWEEN n.s AND n.e GROUP BY c.call_seq)
SELECT 'method' AS kind, m.file, m.name, m.s AS a, m.e AS b, coalesce(e.reason, m.entry_reason) AS reason, m.definitive OR e.reason IS NOT NULL AS flag FROM meth m LEFT JOIN ent e ON m.file = e.file AND m.name = e.name AND m.s = e.s AND m.e = e.e
UNION ALL SELECT 'method', file, name, s, e, reason, true FROM new
UNION ALL SELECT 'call', c.file, NULL, c.call_seq, c.line, NULL, w IS NOT NULL FROM call c LEFT JOIN best ON best.call_seq = c.call_seq""")
def synthetic_entries(spark, sf_dir):
    """Entry blocks that are methods already or become some, and which calls they take over."""
    p, o = F.col("p_partkey"), F.col("o_orderkey")
    part = B.table(spark, sf_dir, "part")
    base = [F.col("p_brand").alias("file"), F.concat(F.lit("n"), "p_size").alias("name"), (p % 40 + 1).alias("start")]
    methods = part.select(p.alias("method_seq"), *base, (p % 40 + 10).alias("end"), F.when(p % 7 == 0, "old").alias("entry_reason"), (p % 14 == 0).alias("definitive"))
    entries = part.where("p_partkey % 5 = 0").select(*base, (p % 40 + 10 - p % 2).alias("end"), F.concat(F.lit("POST /"), p).alias("reason"))
    calls = B.table(spark, sf_dir, "orders").select(o.alias("call_seq"), F.concat(F.lit("Brand#"), o % 25 + 1).alias("file"), (o % 50).alias("line"), F.col("o_custkey").alias("caller_seq"))
    all_, moved = R.with_synthetic(methods, entries, calls)
    shown = all_.select(F.lit("method").alias("kind"), "file", "name", F.col("start").alias("a"), F.col("end").alias("b"), F.col("entry_reason").alias("reason"), F.col("definitive").alias("flag"))
    return shown.unionAll(moved.select(F.lit("call"), "file", F.lit(None).cast("string"), "call_seq", "line", F.lit(None).cast("string"), F.col("caller_seq") < 0))
