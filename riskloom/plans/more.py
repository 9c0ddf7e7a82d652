"""Further registered queries: graph, context, references, text functions, ingest, logs and scans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.storage import cut, shared_dir
from ..operators import context as K
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import references as R
from ..operators import validators as V
from ..operators import verify as L
from ..sources import bridge as B
from ..streaming import runlog as S
from .queries import FINDINGS, HITS, LINES, MERGED, findings, merged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- graph -----------------------------------------------------------------------------------------------------

_SPANS = f"""{LINES},
len_ AS (SELECT doc_id, file, max(line_no) AS n FROM src_lines GROUP BY doc_id, file),
spans AS (SELECT file, 1 AS s, n AS e, 'whole' AS name, 0 AS seq FROM len_
  UNION ALL SELECT file, 5 * k + 1, 5 * k + 5, 'block' || k, 2 * k + 1 FROM (SELECT file, n, unnest(range(0, (n + 4) // 5)) AS k FROM len_)
  UNION ALL SELECT file, 5 * k + 2, 5 * k + 3, 'inner' || k, 2 * k + 2 FROM (SELECT file, n, unnest(range(0, (n + 4) // 5)) AS k FROM len_))"""
_ENCLOSED = f"""WITH {HITS}, {_SPANS[len(LINES) + 2:]},
r AS (SELECT h.doc_id, h.line_no, h.rule_id, p.name, p.s, p.e, row_number() OVER (PARTITION BY h.doc_id, h.line_no, h.rule_id ORDER BY p.e - p.s, p.seq) AS n FROM raw_hits h LEFT JOIN spans p ON p.file = h.file AND h.line_no BETWEEN p.s AND p.e)
SELECT doc_id, line_no, rule_id, name, CAST(s AS BIGINT) AS span_start, CAST(e AS BIGINT) AS span_end FROM r WHERE n = 1"""


def _spans(spark, sf_dir) -> DataFrame:
    n = B.table(spark, sf_dir, "documents").select(B.file_name().alias("file"), F.size(F.split("text", "\n", -1)).alias("n"))
    k = n.select("file", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") + 4) / 5).cast("int") - 1)).alias("k"))
    whole = n.select("file", F.lit(1).alias("start"), F.col("n").alias("end"), F.lit("whole").alias("name"), F.lit(0).alias("seq"))
    block = k.select("file", 5 * F.col("k") + 1, 5 * F.col("k") + 5, F.concat(F.lit("block"), "k"), 2 * F.col("k") + 1)
    inner = k.select("file", 5 * F.col("k") + 2, 5 * F.col("k") + 3, F.concat(F.lit("inner"), "k"), 2 * F.col("k") + 2)
    return whole.unionAll(block).unionAll(inner)


@query(_ENCLOSED)
def enclosing_span(spark, sf_dir):
    points = B.raw_hits(spark, sf_dir).select(F.struct("doc_id", "line_no", "rule_id").alias("point"), "file", F.col("line_no").alias("line"))
    out = G.enclosing(points, _spans(spark, sf_dir))
    return out.select("point.doc_id", "point.line_no", "point.rule_id", "name", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"))


_CALLS = """methods AS (SELECT p_partkey AS method_seq, 'n' || p_partkey % 97 AS name, CASE WHEN p_partkey % 13 = 0 THEN -1 ELSE p_partkey % 3 END AS arity, p_brand AS file, CASE WHEN p_size % 5 = 0 THEN 'boolean' ELSE 'int' END AS return_type FROM part),
calls AS (SELECT o_orderkey AS call_seq, 'n' || o_custkey % 97 AS callee, o_orderkey % 3 AS arity, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS caller_seq FROM orders)"""


def _methods(spark, sf_dir) -> DataFrame:
    p = F.col("p_partkey")
    return B.table(spark, sf_dir, "part").select(p.alias("method_seq"), F.concat(F.lit("n"), p % 97).alias("name"), F.when(p % 13 == 0, -1).otherwise(p % 3).alias("arity"), F.col("p_brand").alias("file"), F.when(F.col("p_size") % 5 == 0, "boolean").otherwise("int").alias("return_type"))


def _calls(spark, sf_dir) -> DataFrame:
    o = F.col("o_orderkey")
    return B.table(spark, sf_dir, "orders").select(o.alias("call_seq"), F.concat(F.lit("n"), F.col("o_custkey") % 97).alias("callee"), (o % 3).alias("arity"), F.when(o % 11 != 0, F.col("o_custkey")).alias("caller_seq"))


@query(f"WITH {_CALLS} SELECT m.method_seq, count(*) AS n, sum(c.call_seq)::BIGINT AS call_sum FROM methods m JOIN calls c ON c.callee = m.name AND (m.arity = -1 OR c.arity = m.arity) WHERE c.caller_seq IS NOT NULL GROUP BY m.method_seq")
def callers(spark, sf_dir):
    return G.caller_totals(_methods(spark, sf_dir), _calls(spark, sf_dir))


_TYPES = """e AS (SELECT DISTINCT * FROM (SELECT 'part' || p_partkey AS type, p_brand AS parent FROM part UNION ALL SELECT p_brand, p_type FROM part UNION ALL SELECT p_type, 'size' || p_size % 4 FROM part
UNION ALL VALUES ('size0', 'size1'), ('size1', 'size2'), ('size2', 'size0')))"""


def _types(spark, sf_dir) -> DataFrame:
    p = B.table(spark, sf_dir, "part")
    e = p.select(F.concat(F.lit("part"), "p_partkey").alias("type"), F.col("p_brand").alias("parent")).unionAll(p.select("p_brand", "p_type")).unionAll(p.select("p_type", F.concat(F.lit("size"), F.col("p_size") % 4)))
    return e.unionAll(spark.createDataFrame([("size0", "size1"), ("size1", "size2"), ("size2", "size0")], "type string, parent string")).distinct()


@query(f"WITH RECURSIVE {_TYPES}, r(type, ancestor) AS (SELECT type, parent FROM e UNION SELECT r.type, e.parent FROM r JOIN e ON e.type = r.ancestor) SELECT type, ancestor FROM r WHERE type <> ancestor")
def ancestors(spark, sf_dir):
    return G.ancestors(_types(spark, sf_dir))


_TRADE = """edges AS (SELECT 'c:' || o_custkey AS caller, 'o:' || o_orderkey AS callee FROM orders UNION ALL SELECT 'o:' || l_orderkey, 'l:' || l_orderkey || ':' || l_linenumber FROM lineitem
UNION ALL SELECT 'l:' || l_orderkey || ':' || l_linenumber, 'p:' || l_partkey FROM lineitem UNION ALL SELECT 's:' || l_suppkey, 'l:' || l_orderkey || ':' || l_linenumber FROM lineitem
UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier)"""
_SEARCH = """r(sink, node, depth) AS (SELECT sink, node, 0 FROM sinks UNION SELECT r.sink, e.caller, r.depth + 1 FROM r JOIN edges e ON e.callee = r.node WHERE r.depth < {depth} AND r.node NOT IN (SELECT node FROM entries)),
best AS (SELECT sink, node, min(depth) AS depth FROM r GROUP BY sink, node)"""


@query(f"WITH RECURSIVE {_TRADE}, sinks AS (SELECT p_partkey AS sink, 'p:' || p_partkey AS node FROM part), entries AS (SELECT 'c:' || c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING'), {_SEARCH.format(depth=3)} SELECT b.sink, b.node AS entry, b.depth FROM best b JOIN entries n ON n.node = b.node")
def trace_fk(spark, sf_dir):
    sinks = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sink"), F.concat(F.lit("p:"), "p_partkey").alias("node"))
    entries = B.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c:"), "c_custkey").alias("node"))
    return G.trace_to_entries(sinks, B.trade_edges(spark, sf_dir), entries, 3, paths=False, ahead=True)


_EVENTS = """nodes AS (SELECT user_id, event_type, ts, event_id, user_id || '#' || event_type || '#' || hour(ts) AS node FROM events),
edges AS (SELECT DISTINCT node AS caller, callee FROM (SELECT node, lead(node) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee FROM nodes) WHERE callee IS NOT NULL),
sinks AS (SELECT DISTINCT node AS sink, node FROM nodes WHERE event_type = 'error'), entries AS (SELECT DISTINCT node FROM nodes WHERE event_type = 'signup')"""


def _event_trace(spark, sf_dir) -> DataFrame:
    nodes = B.event_nodes(spark, sf_dir)
    sinks = nodes.where("event_type = 'error'").select(F.col("node").alias("sink"), "node").distinct()
    return G.trace_to_entries(sinks, B.event_edges(spark, sf_dir), nodes.where("event_type = 'signup'").select("node").distinct(), 20, paths=False)


@query(f"WITH RECURSIVE {_EVENTS}, {_SEARCH.format(depth=20)} SELECT b.sink, b.node AS entry, b.depth FROM best b JOIN entries n ON n.node = b.node")
def trace_events(spark, sf_dir):
    return _event_trace(spark, sf_dir)


@query(f"WITH RECURSIVE {_EVENTS}, {_SEARCH.format(depth=20)}, f AS (SELECT b.sink, b.node AS entry, b.depth, row_number() OVER (PARTITION BY b.sink ORDER BY b.depth, b.node) AS place FROM best b JOIN entries n ON n.node = b.node) SELECT * FROM f WHERE place <= 4")
def top_chains(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("sink").orderBy("depth", "entry"))
    return _event_trace(spark, sf_dir).select("sink", "entry", "depth", place.alias("place")).where("place <= 4")


_LEAF = f"""WITH RECURSIVE {_TRADE}, s AS (SELECT 'p:' || p_partkey AS node FROM part), r(start, node) AS (SELECT node, node FROM s UNION SELECT r.start, e.caller FROM r JOIN edges e ON e.callee = r.node),
leaf AS (SELECT start, node FROM r WHERE node NOT IN (SELECT callee FROM edges))"""


def _leaves(spark, sf_dir) -> DataFrame:
    starts = B.table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("node"))
    return G.leaves(starts, B.trade_edges(spark, sf_dir), None)


@query(f"{_LEAF} SELECT start, node AS leaf FROM leaf")
def closure_leaves(spark, sf_dir):
    return _leaves(spark, sf_dir)


@query(f"{_LEAF} SELECT start, count(*) AS n, CASE WHEN count(*) = 1 AND min(node) = start THEN 'unused' WHEN bool_and(node LIKE 'n:1%') THEN 'all main' WHEN count(*) > 4 THEN 'many' ELSE 'listed' END AS class, array_to_string(list_sort(list(node))[1:4], ',') AS shown FROM leaf GROUP BY start")
def unreachable_class(spark, sf_dir):
    return K.classify_leaves(_leaves(spark, sf_dir), F.col("leaf").startswith("n:1"))


# --- context, references, validators ---------------------------------------------------------------------------

_SINK = "sk AS (SELECT DISTINCT c_custkey AS sink, 'Brand#1' || c_custkey % 5 + 1 AS sink_file, 40 + c_custkey % 50 AS sink_line FROM customer)"
_SITE = "sites AS (SELECT k.sink, k.sink_file, k.sink_line, c.o_orderkey AS call_seq, 'n' || c.o_orderkey % 997 AS callee, c.o_orderkey % 3 AS arity, c.o_orderkey % 90 AS line FROM sk k JOIN orders c ON c.o_custkey = k.sink)"
_WIDE = "methods AS (SELECT p_partkey AS method_seq, 'n' || p_partkey % 997 AS name, p_partkey % 3 AS arity, p_brand AS file, CASE WHEN p_size % 5 = 0 THEN 'boolean' ELSE 'int' END AS return_type FROM part)"


def _sites(spark, sf_dir) -> DataFrame:
    k = F.col("o_custkey")
    o = F.col("o_orderkey")
    known = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).distinct()
    return B.table(spark, sf_dir, "orders").join(known, "o_custkey").select(k.alias("sink"), F.concat(F.lit("Brand#1"), k % 5 + 1).alias("sink_file"), (40 + k % 50).alias("sink_line"), o.alias("call_seq"), F.concat(F.lit("n"), o % 997).alias("callee"), (o % 3).alias("arity"), (o % 90).alias("line"))


@query(f"""WITH {_SINK}, {_SITE}, {_WIDE},
one AS (SELECT s.sink, s.sink_line - s.line AS far, s.call_seq, CASE WHEN count(*) = 1 THEN min(m.method_seq) ELSE min(m.method_seq) FILTER (WHERE m.file = s.sink_file) END AS method_seq FROM sites s JOIN methods m ON m.name = s.callee AND m.arity = s.arity
  WHERE s.line <= s.sink_line GROUP BY s.sink, s.sink_line, s.line, s.call_seq HAVING count(*) = 1 OR count(*) FILTER (WHERE m.file = s.sink_file) = 1),
near AS (SELECT sink, method_seq, far, call_seq, row_number() OVER (PARTITION BY sink, method_seq ORDER BY far, call_seq) AS n FROM one)
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY far, call_seq) AS rank FROM near WHERE n = 1) WHERE rank <= 3""")
def callee_unique(spark, sf_dir):
    p = F.col("p_partkey")
    wide = B.table(spark, sf_dir, "part").select(p.alias("method_seq"), F.concat(F.lit("n"), p % 997).alias("name"), (p % 3).alias("arity"), F.col("p_brand").alias("file"), F.lit("int").alias("return_type"))
    return G.unique_callees(_sites(spark, sf_dir), wide).select("sink", "method_seq", "far", "call_seq", F.col("rank").cast("long").alias("rank"))


_REFS = """refs AS (SELECT s_suppkey AS ref_seq, 'Brand#1' || s_suppkey % 5 + 1 AS file, 'n' || s_suppkey % 97 AS name, 'route ' || s_suppkey AS reason FROM supplier),
meth AS (SELECT method_seq, file, name, CASE WHEN method_seq % 7 = 0 THEN 'GET /' END AS entry_reason, method_seq % 14 = 0 AS definitive FROM (SELECT p_partkey AS method_seq, p_brand AS file, 'n' || p_partkey % 97 AS name FROM part))"""


def _refs(spark, sf_dir):
    s = F.col("s_suppkey")
    return B.table(spark, sf_dir, "supplier").select(s.alias("ref_seq"), F.concat(F.lit("Brand#1"), s % 5 + 1).alias("file"), F.concat(F.lit("n"), s % 97).alias("name"), F.concat(F.lit("route "), s).alias("reason"))


def _entries(spark, sf_dir):
    m = F.col("method_seq")
    return _methods(spark, sf_dir).select("method_seq", "file", "name", F.when(m % 7 == 0, "GET /").alias("entry_reason"), (m % 14 == 0).alias("definitive"))


@query(f"WITH {_REFS}, f AS (SELECT file, name, arg_min(reason, ref_seq) AS reason FROM refs GROUP BY file, name) SELECT m.method_seq, CASE WHEN NOT m.definitive AND f.reason IS NOT NULL THEN f.reason ELSE m.entry_reason END AS entry_reason, m.definitive OR f.reason IS NOT NULL AS definitive FROM meth m LEFT JOIN f ON f.file = m.file AND f.name = m.name")
def route_refs_same_file(spark, sf_dir):
    return R.apply_references(_entries(spark, sf_dir), _refs(spark, sf_dir), ["file", "name"]).select("method_seq", "entry_reason", "definitive")


@query(f"WITH {_REFS}, f AS (SELECT name, arg_max(reason, ref_seq) AS reason FROM refs GROUP BY name) SELECT m.method_seq, CASE WHEN m.entry_reason IS NULL AND f.reason IS NOT NULL THEN f.reason ELSE m.entry_reason END AS entry_reason, m.definitive OR (m.entry_reason IS NULL AND f.reason IS NOT NULL) AS definitive FROM meth m LEFT JOIN f ON f.name = m.name")
def route_refs_global(spark, sf_dir):
    return R.apply_references(_entries(spark, sf_dir), _refs(spark, sf_dir), ["name"], last=True, only_blank=True).select("method_seq", "entry_reason", "definitive")


@query("""WITH q AS (SELECT doc_id AS statement, 'com.' || source || '.' || lang AS namespace FROM documents), c AS (SELECT DISTINCT source || '.' || lang AS owner FROM documents)
SELECT q.statement, c.owner FROM q JOIN c ON q.namespace = c.owner OR q.namespace LIKE '%.' || c.owner""")
def suffix_link(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    q = docs.select(F.col("doc_id").alias("statement"), F.concat_ws(".", F.lit("com"), "source", "lang").alias("namespace"))
    return R.link_by_suffix(q, docs.select(F.concat_ws(".", "source", "lang").alias("owner")).distinct())


@query(f"WITH {_CALLS} SELECT DISTINCT c.call_seq FROM calls c WHERE EXISTS (SELECT 1 FROM methods m WHERE m.name = c.callee AND m.arity = c.arity AND m.return_type = 'boolean')")
def semi_signature(spark, sf_dir):
    sig = _methods(spark, sf_dir).where("return_type = 'boolean'").select(F.col("name").alias("callee"), "arity")
    return _calls(spark, sf_dir).join(sig, ["callee", "arity"], "left_semi").select("call_seq")


@query(f"WITH {_CALLS} SELECT c.call_seq FROM calls c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey % 2 = 0 AND 'n' || s.s_suppkey = c.callee)")
def anti_macro(spark, sf_dir):
    macros = B.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("n"), "s_suppkey").alias("name"))
    return R.without_macros(_calls(spark, sf_dir), macros).select("call_seq")


@query(f"""WITH {LINES}, n AS (SELECT h.doc_id, h.line_no, greatest(1, h.line_no - 3) AS a, least(len(s.ls), h.line_no + 3) AS b, s.ls FROM (SELECT DISTINCT doc_id, line_no FROM src_lines WHERE regexp_matches(line, '[0-9]{{9}}')) h JOIN src s ON s.doc_id = h.doc_id)
SELECT doc_id, line_no, array_to_string(list_transform(range(a, b + 1), lambda i: lpad(CAST(i AS VARCHAR), 5, ' ') || ' | ' || ls[i]), chr(10)) AS shown FROM n""")
def window_text(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("ls"))
    hits = docs.select("doc_id", "ls", F.posexplode("ls").alias("pos", "line")).where(F.col("line").rlike("[0-9]{9}")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "ls")
    return hits.select("doc_id", "line_no", X.numbered(F.col("ls"), F.col("line_no") - 3, F.col("line_no") + 3).alias("shown"))


@query("""WITH a AS (SELECT l_suppkey AS file, 'buf' || l_partkey % 7 AS name, l_orderkey * 8 + l_linenumber AS pos, CAST(l_quantity AS BIGINT) AS size FROM lineitem WHERE l_linenumber % 2 = 1),
u AS (SELECT row_number() OVER () AS rid, l_suppkey AS file, 'buf' || l_partkey % 7 AS name, l_orderkey * 8 + l_linenumber AS pos, CAST(l_quantity AS BIGINT) AS length FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT u.file, u.name, u.pos, u.length, arg_max(a.size, (a.pos, a.size)) AS capacity FROM u LEFT JOIN a ON a.file = u.file AND a.name = u.name AND a.pos < u.pos GROUP BY u.rid, u.file, u.name, u.pos, u.length""")
def last_capacity(spark, sf_dir):
    declared, used = _buffers(spark, sf_dir)
    return V.last_before(used, declared, ["file", "name"]).select("file", "name", "pos", "length", F.col("size").alias("capacity"))


def _buffers(spark, sf_dir):
    items = B.table(spark, sf_dir, "lineitem")
    at = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    base = [F.col("l_suppkey").alias("file"), F.concat(F.lit("buf"), F.col("l_partkey") % 7).alias("name"), at.alias("pos")]
    declared = items.where("l_linenumber % 2 = 1").select(*base, F.col("l_quantity").cast("long").alias("size"))
    return declared, items.where("l_linenumber % 2 = 0").select(*base, F.col("l_quantity").cast("long").alias("length"))


@query("""WITH a AS (SELECT l_suppkey AS file, 'buf' || l_partkey % 7 AS name, l_orderkey * 8 + l_linenumber AS pos, CAST(l_quantity AS BIGINT) AS size FROM lineitem WHERE l_linenumber % 2 = 1),
u AS (SELECT row_number() OVER () AS rid, l_suppkey AS file, 'buf' || l_partkey % 7 AS name, l_orderkey * 8 + l_linenumber AS pos, CAST(l_quantity AS BIGINT) AS length FROM lineitem WHERE l_linenumber % 2 = 0),
c AS (SELECT u.file, u.name, u.pos, u.length, arg_max(a.size, (a.pos, a.size)) AS capacity FROM u LEFT JOIN a ON a.file = u.file AND a.name = u.name AND a.pos < u.pos GROUP BY u.rid, u.file, u.name, u.pos, u.length)
SELECT file, name, pos, CASE WHEN length IS NULL OR capacity IS NULL THEN 'unknown' WHEN length > capacity THEN 'overflow' ELSE 'safe' END AS verdict FROM c""")
def bounds_verdict(spark, sf_dir):
    declared, used = _buffers(spark, sf_dir)
    out = V.last_before(used, declared, ["file", "name"])
    return out.select("file", "name", "pos", V.bounds(F.col("length"), F.col("size")).alias("verdict"))


@query(f"""WITH {LINES}, t AS (SELECT DISTINCT file, unnest(regexp_extract_all(line, '"([A-Za-z_$][A-Za-z0-9_$]{{2,63}})"', 1)) AS literal FROM src_lines)
SELECT literal, count(*) AS files FROM t GROUP BY literal""")
def string_literal_index(spark, sf_dir):
    return R.literal_index(B.src_lines(spark, sf_dir)).groupBy("literal").agg(F.count("*").alias("files"))


# --- verification, translation ---------------------------------------------------------------------------------


@query(f"WITH {MERGED} SELECT m.dedup_key, sha256('model-a:' || 'verify ' || m.dedup_key) AS key FROM merged m WHERE m.mode <> 'static' AND m.severity <> 'INFO'")
def llm_cache_miss(spark, sf_dir):
    asked = L.requests(merged(spark, sf_dir), "model-a")
    cache = asked.where("severity = 'INFO'").select("key", F.lit("{}").alias("response"))
    return L.misses(asked, cache).select("dedup_key", "key")


@query(f"WITH {MERGED} SELECT dedup_key, CASE WHEN mode = 'static' THEN 'yes' END AS reachable, CASE WHEN mode = 'static' THEN CASE confidence WHEN 'HIGH' THEN 95 WHEN 'LOW' THEN 55 ELSE 75 END END AS confidence FROM merged")
def verify_static_split(spark, sf_dir):
    out = L.static_verdicts(merged(spark, sf_dir))
    return out.select("dedup_key", F.col("finding.reachable").alias("reachable"), F.col("finding.confidence").alias("confidence"))


@query(r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN repeat('漏洞', CAST(conv_id % 60 AS INTEGER)) ELSE '' END AS x FROM conversations),
c AS (SELECT conv_id, turn, len(regexp_extract_all(x, '[\x{4e00}-\x{9fff}]')) AS h, len(regexp_extract_all(x, '[A-Za-z]')) AS l FROM t)
SELECT conv_id, turn, CASE WHEN h + l > 0 AND h / (h + l) >= 0.15 THEN 'zh' ELSE 'en' END AS language FROM c""")
def detect_language(spark, sf_dir):
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, F.repeat(F.lit("漏洞"), (F.col("conv_id") % 60).cast("int"))).otherwise(""))
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.language(text).alias("language"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND trim(role) <> '' THEN trim(role) ELSE text END AS text_zh, text AS text_en FROM conversations")
def apply_translation(spark, sf_dir):
    df = B.table(spark, sf_dir, "conversations").withColumn("translated", F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("  "))
    return L.apply_translation(df, "text", "translated", "zh", "en").select("conv_id", "turn", "text_zh", "text_en")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN CASE WHEN turn % 2 = 0 THEN 'yes' ELSE 'no' END ELSE 'uncertain' END AS reachable, turn % 4 = 3 AS failed FROM conversations")
def parse_llm_json(spark, sf_dir):
    body = F.concat(F.lit('{"reachable": "'), F.when(F.col("turn") % 2 == 0, "yes").otherwise("no"), F.lit('", "confidence": 80}'))
    reply = F.when(F.col("turn") % 4 == 3, F.lit("no json here")).when(F.col("turn") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    df = L.parse_replies(B.table(spark, sf_dir, "conversations").withColumn("reply", reply))
    return df.select("conv_id", "turn", F.col("finding.reachable").alias("reachable"), F.coalesce(F.col("finding.reasoning").contains("verifier_failed"), F.lit(False)).alias("failed"))


# --- ingest, logs, scans ---------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT source, doc_id, total <= 60000 AND n <= 40 AS accepted FROM d""")
def ingest_quota(spark, sf_dir):
    df = B.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return I.quota(df, "source", "doc_id", "n_chars", 60_000, 40).select("source", "doc_id", "accepted")


@query("""WITH e AS (SELECT source, source || CASE WHEN CAST(substr(source, 4) AS INTEGER) % 3 = 0 AND doc_id % 50 > 30 THEN 'x' ELSE '' END || '/' || lang || '/d' || doc_id AS path FROM documents),
r AS (SELECT source, count(DISTINCT string_split(path, '/')[1]) = 1 AS one, min(string_split(path, '/')[1]) AS root FROM e GROUP BY source)
SELECT e.source, e.path, CASE WHEN r.one THEN substr(e.path, length(r.root) + 2) ELSE e.path END AS stripped FROM e JOIN r ON r.source = e.source""")
def common_root(spark, sf_dir):
    odd = (F.substring("source", 4, 9).cast("int") % 3 == 0) & (F.col("doc_id") % 50 > 30)
    path = F.concat(F.col("source"), F.when(odd, "x").otherwise(""), F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id"))
    return I.strip_common_root(B.table(spark, sf_dir, "documents").select("source", path.alias("path")), "source").select("source", "path", "stripped")


@query("SELECT user_id AS scan_id, count(*) FILTER (WHERE event_id > 500) AS fresh, (SELECT max(event_id) FROM events) AS mark FROM events GROUP BY user_id")
def log_since(spark, sf_dir):
    log = B.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("scan_id"), F.col("event_type").alias("text"))
    per = log.select("scan_id").distinct().join(S.since(log, 500).groupBy("scan_id").agg(F.count("*").alias("fresh")), "scan_id", "left")
    return per.select("scan_id", F.coalesce("fresh", F.lit(0)).alias("fresh"), S.mark(log).scalar().alias("mark"))


@query("SELECT user_id AS scan_id, arg_max(event_type, (ts, event_id)) AS stage, count(*) AS done FROM events GROUP BY user_id")
def stage_progress(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), F.col("event_type").alias("stage"), "ts", F.col("event_id").alias("seq"))
    return S.progress(e).select("scan_id", "stage", "done")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new, event_id FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id AS page, CAST(session AS BIGINT) AS session, count(*) AS beats, CAST(epoch(max(ts) - min(ts)) AS BIGINT) AS seconds FROM s GROUP BY user_id, session""")
def heartbeat_sessions(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), "ts", F.col("event_id").alias("seq"))
    return S.sessions(e, 6 * 3600)


@query("""WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id) SELECT status, count(*) AS scans, status IN ('view', 'click') AS running FROM s GROUP BY status""")
def scan_status_last(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), F.col("event_type").alias("stage"), "ts", F.col("event_id").alias("seq"))
    return S.progress(e).groupBy(F.col("stage").alias("status")).agg(F.count("*").alias("scans")).withColumn("running", F.col("status").isin("view", "click"))


@query(f"WITH {FINDINGS} SELECT report_id, dedup_key AS candidate_id, verdict AS reachable FROM finding")
def persisted_findings(spark, sf_dir):
    return findings(spark, sf_dir).select("report_id", F.col("dedup_key").alias("candidate_id"), X.verdict().alias("reachable"))


@query()
def verify_stub(spark, sf_dir):
    """Requests, a cache that an earlier run has filled for a third of them, and a stand-in model for the rest: replies that do not parse are asked for once
    more, and what was asked is written through.  Replies of the earlier run are the surer ones, so the result says where each came from."""
    asked = cut(L.requests(merged(spark, sf_dir), "stub").select("dedup_key", "prompt", "key"), "asked")
    judged = lambda digit, sure: F.concat(F.lit('{"reachable": "'), F.when(F.conv(digit, 16, 10).cast("int") % 2 == 1, "yes").otherwise("no"), F.lit(f'", "confidence": {sure}}}'))
    at = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    L.merge_cache(spark, at, asked.where(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % 3 == 0).select("key", judged(F.right("prompt", F.lit(1)), 90).alias("reply")))

    def provider():
        return lambda text: '```json\n{"reachable": "%s", "confidence": 70}\n```' % ("yes" if int(text[-1], 16) % 2 else "no")

    rows, _ = L.ask_cached(asked, at, provider, parse=L.json_object)
    return L.parse_replies(rows).select("dedup_key", F.col("finding.reachable").alias("reachable"), F.col("finding.confidence").alias("confidence"))
