"""Registered queries: what encloses a call, and what a variable was last given.  Orders and their lines are nested spans of few, large files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nesting as Y
from ..sources import bridge as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_SPANS = """o AS (SELECT o_orderkey AS k, 'f' || o_custkey % 5 AS file, o_orderkey * 10 AS a, o_orderkey * 10 + 10 AS b, o_orderpriority = '1-URGENT' AS urgent FROM orders),
cl AS (SELECT DISTINCT file, k // 40 * 400 AS a, k // 40 * 400 + 400 AS b, k // 40 % 3 = 0 AS guarded FROM o),
li AS (SELECT l.l_orderkey, l.l_linenumber, o.file, o.a + l.l_linenumber AS a, o.a + l.l_linenumber + 1 AS b FROM lineitem l JOIN o ON o.k = l.l_orderkey)"""


def _spans(spark, sf_dir):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("long")
    orders = B.table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("f"), F.col("o_custkey") % 5).alias("file"), (k * 10).alias("start"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    bodies = orders.select(F.lit("method").alias("kind"), "k", F.lit(None).cast("int").alias("n"), "file", "start", (F.col("start") + 10).alias("end"), F.col("urgent").alias("marked"))
    g = F.floor(F.col("k") / 40)
    classes = orders.select(F.lit("class").alias("kind"), none.alias("k"), F.lit(None).cast("int").alias("n"), "file", (g * 400).alias("start"), (g * 400 + 400).alias("end"), (g % 3 == 0).alias("marked")).distinct()
    at = orders.select(F.col("k").alias("l_orderkey"), "file", "start")
    lines = B.table(spark, sf_dir, "lineitem").join(at, "l_orderkey").select(F.lit("call").alias("kind"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "file", (F.col("start") + F.col("l_linenumber")).alias("start"), (F.col("start") + F.col("l_linenumber") + 1).alias("end"), F.lit(False).alias("marked"))
    return lines, bodies.unionAll(classes)


@query(f"""WITH {_SPANS} SELECT l_orderkey AS k, l_linenumber AS n, file, a AS start, b AS "end" FROM li WHERE EXISTS (SELECT 1 FROM cl WHERE cl.file = li.file AND cl.a <= li.a AND cl.b >= li.b AND cl.guarded)
AND NOT EXISTS (SELECT 1 FROM o WHERE o.k = li.l_orderkey AND o.file = li.file AND o.a <= li.a AND o.b >= li.b AND o.urgent)""")
def enclosed_calls(spark, sf_dir):
    """Calls inside a marked class and not inside a marked method."""
    lines, outer = _spans(spark, sf_dir)
    return Y.enclosed(lines, "kind = 'class' AND marked", "kind = 'method' AND marked", outer).select("k", "n", "file", "start", "end")


@query("""WITH g AS (SELECT user_id % 5 AS unit, 'v' || event_id % 50 AS name, event_id AS at, event_type = 'signup' AS source FROM events WHERE event_id % 3 > 0), u AS (SELECT event_id AS use_id, user_id % 5 AS unit, 'v' || event_id // 3 % 50 AS name, event_id AS at FROM events WHERE event_id % 3 = 0)
SELECT u.use_id, u.name, coalesce(arg_max(g.source, g.at), false) AS tainted FROM u LEFT JOIN g ON g.unit = u.unit AND g.name = u.name AND g.at <= u.at GROUP BY u.use_id, u.name""")
def tainted_uses(spark, sf_dir):
    e = F.col("event_id")
    events = B.table(spark, sf_dir, "events").withColumn("unit", F.col("user_id") % 5)
    given = events.where(e % 3 > 0).select("unit", F.concat(F.lit("v"), e % 50).alias("name"), e.alias("at"), (F.col("event_type") == "signup").alias("source"))
    uses = events.where(e % 3 == 0).select(e.alias("use_id"), "unit", F.concat(F.lit("v"), F.floor(e / 3) % 50).alias("name"), e.alias("at"))
    return Y.tainted_uses(given, uses).select("use_id", "name", "tainted")
