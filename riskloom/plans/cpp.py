"""Registered queries: allocation forms, include resolution, framework references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forms as M
from ..operators import includes as I
from ..operators import references as R
from ..sources import bridge as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# Customers are functions (of a file for each nation and five), orders are their statements.
_STATEMENTS = """o AS (SELECT 'f' || o_custkey AS function, o_custkey AS k, o_orderkey AS n, o_orderkey % 11 AS way, 'p' || o_orderkey // 11 % 12 AS symbol, 'p' || (o_orderkey // 11 + 1) % 12 AS after, CASE WHEN (o_custkey // 40 + o_orderkey % 53 // 50) % 2 = 0 THEN 'array' ELSE 'scalar' END AS form FROM orders),
files AS (SELECT 'f' || c_custkey AS function, 'n' || c_nationkey || '_' || c_custkey // 60 AS file, c_custkey AS k FROM customer),
news AS (SELECT function, symbol, form FROM o WHERE way = 5 UNION ALL SELECT function, 'this.m', form FROM o WHERE way = 5 AND k % 6 = 0),
copies AS (SELECT function, symbol AS dst_symbol, after AS src_symbol FROM o WHERE way < 5 UNION ALL SELECT function, 'p3', 'q' FROM files WHERE k % 4 = 0
  UNION ALL SELECT function, 'p' || i, 'p' || i + 1 FROM files, range(11) t(i) WHERE k % 7 = 0),
results AS (SELECT function, symbol, 'f' || k // 2 AS called FROM o WHERE way = 6),
returns AS (SELECT function, CASE WHEN k % 5 = 0 THEN CASE WHEN k // 40 % 2 = 0 THEN 'array' ELSE 'scalar' END END AS form, CASE WHEN k % 5 IN (1, 2) THEN 'p0' END AS symbol, CASE WHEN k % 5 = 3 THEN 'f' || k // 3 END AS called FROM files),
params AS (SELECT function, 0 AS place, 'q' AS symbol FROM files),
args AS (SELECT function, 'f' || k + way - 7 AS called, 0 AS place, CASE WHEN way = 8 THEN form END AS form, CASE WHEN way <> 8 THEN symbol END AS symbol FROM o WHERE way BETWEEN 7 AND 9),
uses AS (SELECT n AS use_id, function, CASE WHEN n % 4 = 0 THEN 'q' WHEN n % 9 = 0 THEN 'this.m' ELSE 'p' || n // 7 % 12 END AS symbol, CASE WHEN n % 2 = 0 THEN 'array' ELSE 'scalar' END AS released FROM o)"""
_FORMS = f"""{_STATEMENTS},
within_ AS (SELECT DISTINCT src, dst FROM (SELECT 'v|' || function || '|' || src_symbol AS src, 'v|' || function || '|' || dst_symbol AS dst FROM copies UNION ALL SELECT 'v|' || function || '|' || dst_symbol, 'v|' || function || '|' || src_symbol FROM copies
  UNION ALL SELECT 'r|' || called, 'v|' || function || '|' || symbol FROM results UNION ALL SELECT 'v|' || function || '|' || symbol, 'r|' || function FROM returns UNION ALL SELECT 'r|' || called, 'r|' || function FROM returns) WHERE src IS NOT NULL AND dst IS NOT NULL),
s1(node, form) AS (SELECT 'v|' || function || '|' || symbol, form FROM news UNION SELECT 'r|' || function, form FROM returns WHERE form IS NOT NULL UNION SELECT w.dst, s.form FROM s1 s JOIN within_ w ON w.src = s.node),
f1 AS MATERIALIZED (SELECT node, CASE WHEN count(DISTINCT form) = 1 THEN min(form) ELSE 'conflict' END AS form FROM s1 GROUP BY node),
named AS (SELECT DISTINCT x.function, x.symbol, f.file FROM (SELECT function, dst_symbol AS symbol FROM copies UNION SELECT function, src_symbol FROM copies UNION SELECT function, symbol FROM results UNION SELECT function, symbol FROM returns UNION SELECT function, symbol FROM args
  UNION SELECT function, symbol FROM params UNION SELECT function, symbol FROM news) x JOIN files f ON f.function = x.function WHERE x.symbol IS NOT NULL),
s2(node, form) AS (SELECT 'v|' || n.function || '|' || n.symbol, w.form FROM named n JOIN (SELECT DISTINCT f.file, w.symbol, w.form FROM news w JOIN files f ON f.function = w.function) w ON w.file = n.file AND w.symbol = n.symbol WHERE 'v|' || n.function || '|' || n.symbol NOT IN (SELECT node FROM f1)
  UNION SELECT w.dst, s.form FROM s2 s JOIN within_ w ON w.src = s.node WHERE w.dst NOT IN (SELECT node FROM f1)),
f2 AS MATERIALIZED (SELECT * FROM f1 UNION ALL SELECT node, CASE WHEN count(DISTINCT form) = 1 THEN min(form) ELSE 'conflict' END FROM s2 GROUP BY node),
handed AS (SELECT DISTINCT 'v|' || a.called || '|' || p.symbol AS dst, a.form, 'v|' || a.function || '|' || a.symbol AS src FROM args a JOIN params p ON p.function = a.called AND p.place = a.place),
ways AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst FROM within_ UNION SELECT src, dst FROM handed WHERE src IS NOT NULL) WHERE dst NOT IN (SELECT node FROM f2)),
s3(node, form) AS (SELECT dst, form FROM handed WHERE form IS NOT NULL AND dst NOT IN (SELECT node FROM f2)
  UNION SELECT h.dst, x.form FROM handed h JOIN f2 ON f2.node = h.src JOIN (VALUES ('array'), ('scalar')) x(form) ON f2.form IN (x.form, 'conflict') WHERE h.dst NOT IN (SELECT node FROM f2)
  UNION SELECT w.dst, s.form FROM s3 s JOIN ways w ON w.src = s.node),
f3 AS (SELECT * FROM f2 UNION ALL SELECT node, CASE WHEN count(DISTINCT form) = 1 THEN min(form) ELSE 'conflict' END FROM s3 GROUP BY node)"""


@query(f"""WITH RECURSIVE {_FORMS} SELECT u.use_id, u.function, u.symbol, u.released, coalesce(f3.form, 'unknown') AS form, coalesce(f3.form IN ('array', 'scalar') AND f3.form <> u.released, false) AS confirmed
FROM uses u LEFT JOIN f3 ON f3.node = 'v|' || u.function || '|' || u.symbol""")
def allocation_form(spark, sf_dir):
    k, n = F.col("o_custkey"), F.col("o_orderkey")
    at = F.floor(n / 11)
    which = lambda x: F.when(x % 2 == 0, "array").otherwise("scalar")
    f = lambda x: F.concat(F.lit("f"), x.cast("string"))
    o = B.table(spark, sf_dir, "orders").select(
        f(k).alias("function"), k.alias("k"), n.alias("n"), (n % 11).alias("way"), F.concat(F.lit("p"), at % 12).alias("symbol"), F.concat(F.lit("p"), (at + 1) % 12).alias("after"), which(F.floor(k / 40) + F.floor(n % 53 / 50)).alias("form")
    )
    c = F.col("c_custkey")
    files = B.table(spark, sf_dir, "customer").select(f(c).alias("function"), F.concat(F.lit("n"), "c_nationkey", F.lit("_"), F.floor(c / 60)).alias("file"), c.alias("k"))
    news = o.where("way = 5").select("function", "symbol", "form").unionAll(o.where("way = 5 AND k % 6 = 0").select("function", F.lit("this.m"), "form"))
    copies = o.where("way < 5").select("function", F.col("symbol").alias("dst_symbol"), F.col("after").alias("src_symbol")).unionAll(files.where("k % 4 = 0").select("function", F.lit("p3"), F.lit("q")))
    chain = files.where("k % 7 = 0").select("function", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"))
    copies = copies.unionAll(chain.select("function", F.concat(F.lit("p"), "i"), F.concat(F.lit("p"), F.col("i") + 1)))
    results = o.where("way = 6").select("function", "symbol", f(F.floor(F.col("k") / 2)).alias("called"))
    j = F.col("k")
    returns = files.select("function", F.when(j % 5 == 0, which(F.floor(j / 40))).alias("form"), F.when((j % 5).isin(1, 2), "p0").alias("symbol"), F.when(j % 5 == 3, f(F.floor(j / 3))).alias("called"))
    params = files.select("function", F.lit(0).alias("place"), F.lit("q").alias("symbol"))
    args = o.where("way BETWEEN 7 AND 9").select("function", f(j + F.col("way") - 7).alias("called"), F.lit(0).alias("place"), F.when(F.col("way") == 8, F.col("form")).alias("form"), F.when(F.col("way") != 8, F.col("symbol")).alias("symbol"))
    m = F.col("n")
    uses = o.select(m.alias("use_id"), "function", F.when(m % 4 == 0, "q").when(m % 9 == 0, "this.m").otherwise(F.concat(F.lit("p"), F.floor(m / 7) % 12)).alias("symbol"), which(m).alias("released"))
    found = M.allocation_form(news, copies, results, returns, params, args, files.select("function", "file"))
    return M.release_mismatch(uses, found).select("use_id", "function", "symbol", "released", "form", "confirmed")


# Parts are headers in folders, lineitems include them in several spellings, right and wrong.
_INCLUDES = """files AS (SELECT p_partkey AS k, 'src/a' || p_partkey % 7 || '/b' || p_partkey % 3 || '/h' || p_partkey || '.h' AS file FROM part UNION ALL SELECT p_partkey, 'h' || p_partkey || '.h' FROM part WHERE p_partkey % 10 = 0),
t AS (SELECT f.file, f.k, l.l_linenumber AS way, greatest(1, CASE WHEN l.l_suppkey % 20 = 0 THEN f.k + 1 ELSE f.k // 2 + l.l_suppkey % 3 END) AS t FROM lineitem l JOIN files f ON f.k = l.l_partkey),
inc AS (SELECT file, CASE way % 7 WHEN 0 THEN 'h' || t || '.h' WHEN 1 THEN '../../a' || t % 7 || '/b' || t % 3 || '/h' || t || '.h' WHEN 2 THEN 'src/a' || t % 7 || '/b' || t % 3 || '/h' || t || '.h' WHEN 3 THEN './x/..//../b' || t % 3 || '/h' || t || '.h'
  WHEN 4 THEN '/src/a' || t % 7 || '/b' || t % 3 || '/h' || t || '.h' WHEN 5 THEN '../../../../../h' || t || '.h' ELSE 'src/./a' || t % 7 || '/c/../b' || t % 3 || '/h' || t || '.h' END AS included FROM t),
readings AS (SELECT file, included, r, CASE WHEN included[1] <> '/' THEN array_to_string(list_reduce(list_filter(string_split(CASE WHEN r = 1 THEN regexp_replace(file, '[^/]*$', '') ELSE '' END || included, '/'), lambda x: x <> '' AND x <> '.'),
  lambda a, x: CASE WHEN x = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[:-2] ELSE list_append(a, x) END, []::VARCHAR[]), '/') END AS path FROM (SELECT DISTINCT file, included FROM inc), (VALUES (1), (2)) v(r)),
best AS (SELECT x.file, x.included, arg_min(f.file, x.r) AS target, min(x.r) FILTER (WHERE f.file IS NOT NULL) AS r FROM readings x LEFT JOIN (SELECT DISTINCT file FROM files) f ON f.file = x.path GROUP BY x.file, x.included)"""


def _includes(spark, sf_dir):
    p = F.col("p_partkey")
    where = lambda x: F.concat(F.lit("src/a"), x % 7, F.lit("/b"), x % 3, F.lit("/h"), x, F.lit(".h"))
    part = B.table(spark, sf_dir, "part").select("p_partkey")
    files = part.select(p.alias("k"), where(p).alias("file")).unionAll(part.where("p_partkey % 10 = 0").select(p, F.concat(F.lit("h"), p, F.lit(".h"))))
    s = F.col("l_suppkey")
    to = F.greatest(F.lit(1), F.when(s % 20 == 0, F.col("k") + 1).otherwise(F.floor(F.col("k") / 2) + s % 3))
    rows = B.table(spark, sf_dir, "lineitem").join(files, F.col("l_partkey") == F.col("k")).select("file", (F.col("l_linenumber") % 7).alias("way"), to.alias("t"))
    t, w = F.col("t"), F.col("way")
    head, full = F.concat(F.lit("h"), t, F.lit(".h")), where(t)
    tail = F.concat(F.lit("b"), t % 3, F.lit("/"), head)
    included = (
        F.when(w == 0, head).when(w == 1, F.concat(F.lit("../../a"), t % 7, F.lit("/"), tail)).when(w == 2, full).when(w == 3, F.concat(F.lit("./x/..//../"), tail))
        .when(w == 4, F.concat(F.lit("/"), full)).when(w == 5, F.concat(F.lit("../../../../../"), head)).otherwise(F.concat(F.lit("src/./a"), t % 7, F.lit("/c/../"), tail))
    )
    return rows.select("file", included.alias("included")), files


@query(f"WITH {_INCLUDES} SELECT i.file, i.included, b.target, CASE b.r WHEN 1 THEN 'own' WHEN 2 THEN 'root' ELSE 'none' END AS found FROM inc i JOIN best b ON b.file = i.file AND b.included = i.included")
def include_edges(spark, sf_dir):
    includes, files = _includes(spark, sf_dir)
    return I.include_edges(includes, files.select("file"))


@query(f"""WITH RECURSIVE {_INCLUDES}, mac AS (SELECT file, 'M' || k % 40 AS name FROM files WHERE k % 9 = 0), ie AS MATERIALIZED (SELECT DISTINCT file, target FROM best WHERE target IS NOT NULL),
r(file, name) AS (SELECT file, name FROM mac UNION SELECT ie.file, r.name FROM r JOIN ie ON ie.target = r.file) SELECT file, name FROM r""")
def included_macros(spark, sf_dir):
    includes, files = _includes(spark, sf_dir)
    return I.included_macros(includes, files.select("file"), files.where("k % 9 = 0").select("file", F.concat(F.lit("M"), F.col("k") % 40).alias("name")))


@query("""WITH m AS (SELECT p_partkey AS method_seq, 'n' || p_partkey % 400 AS name, CASE WHEN p_size % 4 > 0 THEN 'ns::T' || p_size % 9 ELSE '' END AS owner, CASE WHEN p_partkey % 3 = 0 THEN 'java' ELSE 'cpp' END AS language, CASE WHEN p_partkey % 5 = 0 THEN 'old' END AS reason, p_partkey % 10 = 0 AS definitive FROM part),
f AS (SELECT o_orderkey AS ref_seq, 'n' || o_custkey % 600 AS name, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'T' || o_custkey % 9 ELSE 'other::T' || o_custkey % 7 END AS owner, 'ref ' || o_orderkey AS reason FROM orders),
x AS (SELECT m.method_seq, arg_max(f.reason, f.ref_seq) AS reason FROM m JOIN f ON f.name = m.name AND (f.owner = '' OR regexp_replace(f.owner, '^.*::', '') = regexp_replace(m.owner, '^.*::', '')) WHERE m.language = 'cpp' GROUP BY m.method_seq)
SELECT m.method_seq, m.name, m.owner, coalesce(x.reason, m.reason) AS entry_reason, m.definitive OR x.reason IS NOT NULL AS definitive FROM m LEFT JOIN x ON x.method_seq = m.method_seq""")
def route_refs_last(spark, sf_dir):
    p, s, o, k = F.col("p_partkey"), F.col("p_size"), F.col("o_orderkey"), F.col("o_custkey")
    methods = B.table(spark, sf_dir, "part").select(
        p.alias("method_seq"), F.concat(F.lit("n"), p % 400).alias("name"), F.when(s % 4 > 0, F.concat(F.lit("ns::T"), s % 9)).otherwise("").alias("owner"), F.when(p % 3 == 0, "java").otherwise("cpp").alias("language"), F.when(p % 5 == 0, "old").alias("entry_reason"), (p % 10 == 0).alias("definitive")
    )
    owner = F.when(o % 3 == 0, "").when(o % 3 == 1, F.concat(F.lit("T"), k % 9)).otherwise(F.concat(F.lit("other::T"), k % 7))
    refs = B.table(spark, sf_dir, "orders").select(o.alias("ref_seq"), F.concat(F.lit("n"), k % 600).alias("name"), owner.alias("owner"), F.concat(F.lit("ref "), o).alias("reason"))
    return R.apply_last(methods, refs).select("method_seq", "name", "owner", "entry_reason", "definitive")
