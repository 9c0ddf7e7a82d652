"""Further registered queries: type residuals, callbacks, reflective lookups, scans, listings, log tagging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import references as R
from ..operators import scans as N
from ..sources import bridge as B
from ..streaming import runlog as S
from .queries import LINES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_KINDS = ["int", "long", "char", "string", "Foo", "T", "", "size_t"]


@query(f"""WITH t AS (SELECT p_partkey AS id, {_KINDS}[p_partkey % 8 + 1] AS a, {_KINDS}[p_size % 8 + 1] AS p FROM part)
SELECT id, a = '' OR p = '' OR a = p OR regexp_full_match(p, '[A-Z][A-Za-z0-9_]*') OR (list_contains({R.NUMERIC}, a) AND list_contains({R.NUMERIC}, p)) OR (list_contains({R.STRINGS}, a) AND list_contains({R.STRINGS}, p)) AS fits FROM t""")
def types_fit(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    t = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(kinds, (F.col("p_partkey") % 8).cast("int")).alias("a"), F.get(kinds, (F.col("p_size") % 8).cast("int")).alias("p"))
    return t.select("id", R.types_fit(F.array("a"), F.array("p")).alias("fits"))


@query("""WITH s(type, ancestor) AS (SELECT DISTINCT p_brand, p_type FROM part), c AS (SELECT p_partkey AS call, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END AS owner, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Brand#11' END AS target FROM part)
SELECT call FROM c WHERE owner = '' OR target = '' OR owner = target OR EXISTS (SELECT 1 FROM s WHERE s.type = c.owner AND s.ancestor = c.target) OR EXISTS (SELECT 1 FROM s WHERE s.type = c.target AND s.ancestor = c.owner)""")
def related_types(spark, sf_dir):
    part = B.table(spark, sf_dir, "part")
    c = part.select(F.col("p_partkey").alias("call"), F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_brand")).alias("owner"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("Brand#11").alias("target"))
    up = part.select(F.col("p_brand").alias("type"), F.col("p_type").alias("ancestor")).distinct()
    return R.related(c, up, "owner", "target").select("call")


_CB = """calls AS (SELECT o_orderkey AS call_seq, o_custkey % 50 AS caller_seq, 'p' || o_orderkey % 4 AS callee, 'f' || o_orderkey % 6 AS s0, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'g' || o_orderkey % 3 END AS s1 FROM orders),
places AS (SELECT DISTINCT c_custkey % 50 AS caller_seq, unnest([0, 1]) AS pos, unnest(['p0', 'p' || c_custkey % 50 % 4]) AS callee FROM customer), edges AS (SELECT o_orderkey AS call_seq, o_orderkey % 50 AS method_seq FROM orders)"""


@query(f"""WITH {_CB}, inn AS (SELECT c.caller_seq, c.call_seq, p.pos FROM calls c JOIN places p ON p.caller_seq = c.caller_seq AND p.callee = c.callee),
handed AS (SELECT e.method_seq AS caller_seq, 0 AS pos, c.s0 AS symbol FROM edges e JOIN calls c ON c.call_seq = e.call_seq UNION ALL SELECT e.method_seq, 1, c.s1 FROM edges e JOIN calls c ON c.call_seq = e.call_seq)
SELECT DISTINCT i.caller_seq, i.call_seq, h.symbol AS callee FROM inn i JOIN handed h ON h.caller_seq = i.caller_seq AND h.pos = i.pos WHERE h.symbol <> ''""")
def callback_calls(spark, sf_dir):
    o, k = F.col("o_orderkey"), F.col("c_custkey") % 50
    orders = B.table(spark, sf_dir, "orders")
    second = F.when(o % 5 == 0, "").otherwise(F.concat(F.lit("g"), o % 3))
    calls = orders.select(o.alias("call_seq"), (F.col("o_custkey") % 50).alias("caller_seq"), F.concat(F.lit("p"), o % 4).alias("callee"), F.array(F.concat(F.lit("f"), o % 6), second).alias("symbols"))
    methods = B.table(spark, sf_dir, "customer").select(k.alias("method_seq"), F.array(F.lit("p0"), F.concat(F.lit("p"), k % 4)).alias("parameter_names")).distinct()
    return R.callback_calls(calls, methods, orders.select(o.alias("call_seq"), (o % 50).alias("method_seq")))


@query(f"""WITH {LINES}, w AS (SELECT DISTINCT file, unnest(regexp_extract_all(line, '(token|password|secret)')) AS literal FROM src_lines), n(name) AS (VALUES ('token'), ('password'), ('nothing'))
SELECT n.name, coalesce(array_to_string(list_sort(list(w.file))[1:2], ','), '') AS files, greatest(count(w.file) - 2, 0) AS more FROM n LEFT JOIN w ON w.literal = n.name GROUP BY n.name""")
def reflective_lookup(spark, sf_dir):
    found = B.src_lines(spark, sf_dir).select("file", F.explode(F.regexp_extract_all("line", F.lit("(token|password|secret)"), 1)).alias("literal")).distinct()
    return R.reflective_files(spark.createDataFrame([("token",), ("password",), ("nothing",)], "name string"), found).withColumn("more", F.col("more").cast("long"))


@query("""WITH s AS (SELECT 'n' || p_partkey % 97 AS name, p_partkey % 3 AS arity, p_brand AS owner FROM part), c AS (SELECT o_orderkey AS call_seq, 'n' || o_custkey % 97 AS callee, o_orderkey % 3 AS arity, 'Brand#1' || o_orderkey % 5 + 1 AS owner FROM orders)
SELECT c.call_seq, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.name = c.callee AND s.arity = c.arity AND s.owner = c.owner) THEN c.owner ELSE '' END AS target_owner FROM c""")
def implicit_members(spark, sf_dir):
    p, o = F.col("p_partkey"), F.col("o_orderkey")
    sig = B.table(spark, sf_dir, "part").select(F.concat(F.lit("n"), p % 97).alias("name"), (p % 3).alias("arity"), F.col("p_brand").alias("owner"))
    calls = B.table(spark, sf_dir, "orders").select(o.alias("call_seq"), F.concat(F.lit("n"), F.col("o_custkey") % 97).alias("callee"), (o % 3).alias("arity"), F.concat(F.lit("Brand#1"), o % 5 + 1).alias("owner"), F.lit("").alias("target_owner"))
    return R.implicit_members(calls, sig).select("call_seq", "target_owner")


@query("SELECT user_id AS owner, arg_max(event_id, (CAST(event_type = 'signup' AS INTEGER), ts, event_id)) AS config_id FROM events GROUP BY user_id")
def active_config(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    return N.active_config(e.select(F.col("user_id").alias("owner"), F.col("event_id").alias("config_id"), (F.col("event_type") == "signup").alias("is_active"), F.col("ts").alias("created_at")), "owner")


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN 'failed' ELSE event_type END AS status, count(*) AS n FROM events GROUP BY 1")
def interrupted_scans(spark, sf_dir):
    scans = B.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"))
    return N.interrupted(scans, ["view", "click"]).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT owner, id, place FROM (SELECT user_id AS owner, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 3")
def newest_first(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), "ts")
    return N.newest(e, "owner", "ts", 3).select("owner", "id", "place")


@query("SELECT event_id AS seq FROM events ORDER BY event_id DESC LIMIT 2000")
def bounded_log(spark, sf_dir):
    return S.retained(B.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))).select("seq")


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN repeat('*', length(c_name)) ELSE substr(c_name, 1, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) END AS masked FROM customer")
def masked_keys(spark, sf_dir):
    return B.table(spark, sf_dir, "customer").select("c_custkey", X.masked_key(F.col("c_name")).alias("masked"))


@query("""SELECT d.doc_id, b.v FROM documents d JOIN (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) % 4 AS k, doc_id AS o, source FROM documents) x ON x.doc_id = d.doc_id,
LATERAL (SELECT coalesce(arg_max(CASE m.doc_id % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'public' END, m.doc_id) FILTER (WHERE m.doc_id % 5 < 2), 'public') AS v FROM documents m WHERE m.source = d.source AND m.doc_id <= d.doc_id) b""")
def member_visibility(spark, sf_dir):
    marker = F.when(F.col("doc_id") % 5 == 0, "private").when(F.col("doc_id") % 5 == 1, "public")
    members = B.table(spark, sf_dir, "documents").select(F.col("source").alias("class"), F.col("doc_id").alias("pos"), marker.alias("marker"))
    return R.visibility(members).select(F.col("pos").alias("doc_id"), F.col("visibility").alias("v"))


@query("""WITH s AS (SELECT event_id AS scan_id, ts AS a, ts + INTERVAL 40 MINUTE AS b FROM events WHERE event_type = 'signup')
SELECT e.event_id AS seq, CASE WHEN e.ts < s.b THEN s.scan_id END AS scan_id FROM events e ASOF LEFT JOIN (SELECT a, max(b) AS b, max(scan_id) AS scan_id FROM s GROUP BY a) s ON s.a <= e.ts""")
def log_scan_tags(spark, sf_dir):
    """Lines with the scan last begun before them, if it still runs."""
    e = B.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    scans = e.where("event_type = 'signup'").select(F.col("event_id").alias("scan_id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 40 minutes")).alias("end"))
    return S.tag_by_scan(e.select(F.col("event_id").alias("seq"), "ts"), scans).select("seq", "scan_id")
