"""Registered queries: the reply cache, filled in two goes and once more in vain, and the last lines of each log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.storage import cut, shared_dir
from ..operators import references as R
from ..operators import verify as L
from ..sources import bridge as B
from ..streaming import runlog
from .queries import MERGED, merged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_ASKED = f"{MERGED}, asked AS (SELECT dedup_key, sha256('model-a:verify ' || dedup_key) AS key FROM merged WHERE mode <> 'static')"


@query(f"WITH {_ASKED} SELECT dedup_key, key, 'judged ' || dedup_key AS reply, (SELECT count(DISTINCT key) FROM asked WHERE key < '8') AS first, (SELECT count(DISTINCT key) FROM asked WHERE key >= '8') AS then, 0 AS again FROM asked")
def llm_cache_merge(spark, sf_dir):
    asked = cut(L.requests(merged(spark, sf_dir), "model-a").select("dedup_key", "key"), "asked")
    replies = asked.select("key", F.concat(F.lit("judged "), "dedup_key").alias("reply"))
    at = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    added = [L.merge_cache(spark, at, L.misses(x, L.read_cache(spark, at))) for x in (replies.where("key < '8'"), replies, replies)]
    return asked.join(L.read_cache(spark, at).select("key", "reply"), "key").select("dedup_key", "key", "reply", *[F.lit(n).alias(name) for name, n in zip(("first", "then", "again"), added, strict=True)])


@query(f"""WITH n AS (SELECT event_type AS log, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY event_type) AS last FROM events)
SELECT log, event_id, seq FROM n WHERE seq > last - {runlog.RETAINED}""")
def retained_log(spark, sf_dir):
    lines = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("log"), "ts", "event_id")
    return runlog.retained_each(lines, ["ts", "event_id"]).select("log", "event_id", "seq")


@query("""WITH gone AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 = 0), dead AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM gone))
SELECT 'customer' AS kind, c_custkey AS a, NULL AS b FROM customer WHERE c_custkey NOT IN (SELECT k FROM gone) UNION ALL SELECT 'order', o_orderkey, NULL FROM orders WHERE o_orderkey NOT IN (SELECT k FROM dead)
UNION ALL SELECT 'line', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM dead)""")
def delete_cascade(spark, sf_dir):
    t = lambda n: B.table(spark, sf_dir, n)
    customer, orders = t("customer").select("c_custkey"), t("orders").select("o_orderkey", "o_custkey")
    tables = [(customer, ["c_custkey"], []), (orders, ["o_orderkey"], ["o_custkey"]), (t("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], ["l_orderkey"])]
    c, o, l_ = R.delete_cascade(tables, customer.where("c_custkey % 7 = 0"))
    none = F.lit(None).cast("int")
    return c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("a"), none.alias("b")).unionAll(o.select(F.lit("order"), "o_orderkey", none)).unionAll(l_.select(F.lit("line"), "l_orderkey", "l_linenumber"))
