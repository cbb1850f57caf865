"""Merges: snapshot differences, upserts, soft deletes, queues, set operations.

``orders`` before and after dates stand for two scans.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge
from ..operators.relational import dedup_keep_first
from ._registry import query

_OLD = "old AS (SELECT o_orderkey, o_orderstatus AS s, round(o_totalprice, 2) AS p FROM orders WHERE o_orderdate < DATE '1998-01-01')"
_NEW = "new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 2) END AS p FROM orders WHERE o_orderdate >= DATE '1996-01-01')"


def old_scan(t):
    return t.orders.filter("o_orderdate < DATE'1998-01-01'").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.round("o_totalprice", 2).alias("p"))


def new_scan(t):
    k = F.col("o_orderkey")
    return t.orders.filter("o_orderdate >= DATE'1996-01-01'").select("o_orderkey", F.when(k % 10 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"), F.when(k % 7 != 0, F.round("o_totalprice", 2)).alias("p"))


@query(f"""
WITH {_OLD}, {_NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'NEW' WHEN n.o_orderkey IS NULL THEN 'GONE'
  WHEN o.s IS NOT DISTINCT FROM n.s AND o.p IS NOT DISTINCT FROM n.p THEN 'SAME' ELSE 'CHANGED' END AS state FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey""")
def snapshot_diff(t):
    return merge.snapshot_diff(old_scan(t), new_scan(t), ["o_orderkey"], ["s", "p"])


@query(f"WITH {_OLD}, {_NEW} SELECT o_orderkey, s, p FROM new UNION ALL SELECT o_orderkey, s, p FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def upsert_overwrite(t):
    return merge.upsert(old_scan(t), new_scan(t), ["o_orderkey"])


@query(f"WITH {_OLD}, {_NEW} SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.s, o.s) AS s, coalesce(n.p, o.p) AS p FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey")
def upsert_coalesce(t):
    return merge.upsert(old_scan(t), new_scan(t), ["o_orderkey"], keep_known=["p"])


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def insert_or_ignore(t):
    return merge.upsert(old_scan(t), new_scan(t), ["o_orderkey"], insert_only=True)


@query(f"WITH {_OLD}, {_NEW} SELECT o_orderkey, s, p, o_orderkey IN (SELECT o_orderkey FROM new) AS present FROM old")
def soft_delete(t):
    return merge.soft_delete(old_scan(t).withColumn("present", F.lit(True)), new_scan(t), ["o_orderkey"])


@query("""
WITH old AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N'), new AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')
SELECT * FROM new UNION ALL SELECT * FROM old WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new)""")
def replace_children(t):
    rows = lambda flag: t.lineitem.filter(F.col("l_returnflag") == flag).select("l_orderkey", "l_partkey", "l_linenumber")
    return merge.replace_children(rows("N"), rows("R"), "l_orderkey")


_QUEUE = "q AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'done' WHEN 'F' THEN 'failed' ELSE 'running' END AS status, CAST(o_orderkey % 4 AS INTEGER) AS attempts, o_orderpriority AS fingerprint FROM orders WHERE o_orderpriority <> '5-LOW')"
_TARGET = "g AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE o_orderpriority END AS fingerprint FROM orders WHERE o_orderstatus <> 'P')"


def queue_of(t):
    status = F.when(F.col("o_orderstatus") == "O", "done").when(F.col("o_orderstatus") == "F", "failed").otherwise("running")
    return t.orders.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"), F.col("o_orderpriority").alias("fingerprint"))


@query(f"""
WITH {_QUEUE}, {_TARGET}, j AS (SELECT coalesce(q.id, g.id) AS id, status, attempts, q.fingerprint AS old, g.fingerprint AS new,
  CASE WHEN q.id IS NULL THEN 'added' WHEN g.id IS NULL THEN 'untouched' WHEN q.fingerprint IS NOT DISTINCT FROM g.fingerprint THEN 'unchanged' ELSE 'reactivated' END AS outcome FROM q FULL JOIN g ON q.id = g.id)
SELECT id, CASE WHEN outcome IN ('added', 'reactivated') THEN 'pending' ELSE status END AS status, CASE WHEN outcome IN ('added', 'reactivated') THEN 0 ELSE attempts END AS attempts,
  CASE WHEN outcome IN ('added', 'reactivated') THEN new ELSE old END AS fingerprint, outcome FROM j""")
def queue_enqueue(t):
    targets = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "changed").otherwise(F.col("o_orderpriority")).alias("fingerprint"))
    return merge.enqueue(queue_of(t), targets, ["id"])


@query(f"WITH {_QUEUE} SELECT id, CASE WHEN status = 'running' THEN 'pending' ELSE status END AS status, attempts, fingerprint FROM q")
def queue_requeue_stale(t):
    return merge.transition(queue_of(t), "requeue_stale")


@query(f"WITH {_QUEUE} SELECT id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, attempts, fingerprint FROM q")
def queue_requeue_failed(t):
    return merge.transition(queue_of(t), "requeue_failed")


@query("""
WITH d AS (SELECT p_name, min(p_partkey) AS id FROM part WHERE p_size < 5 GROUP BY 1), w AS (SELECT DISTINCT p_name FROM part EXCEPT SELECT p_name FROM d)
SELECT p_name, id FROM d UNION ALL SELECT p_name, (SELECT max(id) FROM d) + row_number() OVER (ORDER BY p_name) FROM w""")
def find_or_create(t):
    known = t.part.filter("p_size < 5").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return merge.find_or_create(known, t.part.select("p_name"), ["p_name"], "id")


@query("""
SELECT kind, path FROM (SELECT 'brand' AS kind, p_brand AS path FROM part UNION SELECT 'type', p_type FROM part UNION SELECT 'segment', c_mktsegment FROM customer
  UNION SELECT 'priority', o_orderpriority FROM orders UNION SELECT 'event', event_type FROM events)""")
def union_distinct_refs(t):
    parts = [(t.part, "brand", "p_brand"), (t.part, "type", "p_type"), (t.customer, "segment", "c_mktsegment"), (t.orders, "priority", "o_orderpriority"), (t.events, "event", "event_type")]
    out = None
    for df, kind, column in parts:
        own = df.select(F.lit(kind).alias("kind"), F.col(column).alias("path"))
        out = own if out is None else out.unionByName(own)
    return out.distinct()


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'")
def set_subtract_unused(t):
    used = t.lineitem.filter("l_returnflag = 'R' AND l_linestatus = 'O'").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey").join(used, "p_partkey", "left_anti").distinct()


@query("""
SELECT id, title, origin FROM (SELECT id, title, origin, row_number() OVER (PARTITION BY id ORDER BY rank, title) AS k FROM (
  SELECT p_partkey AS id, upper(p_name) AS title, 'first' AS origin, 0 AS rank FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_name, 'second', 1 FROM part)) WHERE k = 1""")
def priority_dedupe(t):
    a = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("title"), F.lit("first").alias("origin"), F.lit(0).alias("rank"))
    b = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("second").alias("origin"), F.lit(1).alias("rank"))
    return dedup_keep_first(a.unionByName(b), ["id"], ["rank", "title"]).select("id", "title", "origin")


@query("""
WITH a AS (SELECT o_custkey, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS pos FROM orders WHERE o_orderstatus <> 'O'), b AS (SELECT o_custkey, o_orderkey AS id, o_orderdate AS d FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT o_custkey, id, pos IS NOT NULL AS known, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY pos NULLS LAST, d, id) AS BIGINT) AS place FROM a FULL JOIN b USING (o_custkey, id)""")
def stable_reorder_merge(t):
    """In each user's list known rows keep their order, new ones follow."""
    from pyspark.sql import Window

    own = Window.partitionBy("o_custkey")
    a = t.orders.filter("o_orderstatus <> 'O'").select("o_custkey", F.col("o_orderkey").alias("id"), F.row_number().over(own.orderBy("o_totalprice", "o_orderkey")).alias("at"))
    b = t.orders.filter("o_orderpriority <> '5-LOW'").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("d"))
    place = F.row_number().over(own.orderBy(F.asc_nulls_last("at"), "d", "id")).cast("long")
    return a.join(b, ["o_custkey", "id"], "full").select("o_custkey", "id", F.col("at").isNotNull().alias("known"), place.alias("place"))


@query(f"""
WITH {_OLD}, {_NEW} SELECT o.o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL AND o.p > 250000 THEN coalesce(n.s, o.s) ELSE o.s END AS s, CASE WHEN n.o_orderkey IS NOT NULL AND o.p > 250000 THEN coalesce(n.p, o.p) ELSE o.p END AS p
FROM old o LEFT JOIN new n ON n.o_orderkey = o.o_orderkey""")
def gated_update(t):
    """A gate decides whether a row is updated at all; then known values win in both columns."""
    both = old_scan(t).alias("o").join(new_scan(t).withColumn("hit", F.lit(True)).alias("n"), "o_orderkey", "left")
    gate = F.col("hit").isNotNull() & (F.col("o.p") > 250000)
    return both.select("o_orderkey", *(F.when(gate, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("s", "p")))


@query("SELECT o_orderkey, o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND o_totalprice > 100000 AS ready, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END AS stamp FROM orders")
def computed_update(t):
    """Flags and stamps of all rows by a condition."""
    return t.orders.select("o_orderkey", ((F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 100000)).alias("ready"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")).alias("stamp"))
