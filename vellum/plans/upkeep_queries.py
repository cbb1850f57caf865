"""Queues, cascades, dimensions, versions and paths under new roots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import paths, upkeep
from ..sources import folders
from ._registry import query

_Q = """q AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'running' END AS status, CAST(o_shippriority + length(o_orderpriority) % 3 AS INTEGER) AS attempts,
  CASE o_orderstatus WHEN 'F' THEN 'broken' END AS error, o_orderpriority AS version FROM orders)"""
_Q = _Q.replace("o_shippriority + ", "")


def queue_of(t):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("running")
    return t.orders.select(F.col("o_orderkey").alias("id"), status.alias("status"), (F.length("o_orderpriority") % 3).alias("attempts"), F.when(F.col("o_orderstatus") == "F", "broken").alias("error"), F.col("o_orderpriority").alias("version"))


@query(f"""
WITH {_Q}, k AS (SELECT id FROM q WHERE status = 'pending' ORDER BY version, id LIMIT 25)
SELECT q.id, CASE WHEN k.id IS NULL THEN status ELSE 'running' END AS status, attempts + CASE WHEN k.id IS NULL THEN 0 ELSE 1 END AS attempts, k.id IS NOT NULL AS claimed FROM q LEFT JOIN k USING (id)""")
def queue_claim(t):
    return upkeep.claim(queue_of(t), 25, ["version"]).select("id", "status", "attempts", "claimed")


@query(f"""
WITH {_Q}, r AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'complete' WHEN '2-HIGH' THEN 'skip' WHEN '3-MEDIUM' THEN 'fail' ELSE 'requeue' END AS action FROM orders WHERE o_orderstatus = 'P')
SELECT id, CASE action WHEN 'complete' THEN 'done' WHEN 'skip' THEN 'skipped' WHEN 'fail' THEN 'failed' WHEN 'requeue' THEN 'pending' ELSE status END AS status,
  CAST(CASE WHEN action = 'requeue' THEN greatest(attempts - 1, 0) ELSE attempts END AS INTEGER) AS attempts, CASE WHEN action IN ('skip', 'fail') THEN 'why ' || action WHEN action = 'complete' THEN NULL ELSE error END AS error FROM q LEFT JOIN r USING (id)""")
def queue_settle(t):
    action = F.when(F.col("o_orderpriority") == "1-URGENT", "complete").when(F.col("o_orderpriority") == "2-HIGH", "skip").when(F.col("o_orderpriority") == "3-MEDIUM", "fail").otherwise("requeue")
    results = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), action.alias("action")).withColumn("reason", F.concat(F.lit("why "), "action"))
    return upkeep.settle(queue_of(t), results).select("id", "status", "attempts", "error")


@query(f"WITH {_Q} SELECT id, 'pending' AS status, CAST(0 AS INTEGER) AS attempts FROM q")
def queue_requeue_all(t):
    from ..operators import merge

    return merge.transition(queue_of(t), "requeue_all").select("id", "status", F.col("attempts").cast("int").alias("attempts"))


@query(f"WITH {_Q} SELECT id, CAST(row_number() OVER (PARTITION BY version ORDER BY attempts, id) AS INTEGER) AS place, count(*) OVER (PARTITION BY version) AS total FROM q")
def queue_position(t):
    return upkeep.place_in_queue(queue_of(t), ["version"], ["attempts", "id"]).select("id", "place", "total")


@query("""
WITH q AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'done' ELSE 'pending' END AS status, CAST(l_suppkey % 2 AS VARCHAR) AS version, CAST(l_linenumber AS INTEGER) AS attempts FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN status = 'done' AND version <> '1' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'done' AND version <> '1' THEN 0 ELSE attempts END AS attempts, status = 'done' AND version <> '1' AS reset FROM q""")
def version_reset(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", "done").otherwise("pending").alias("status"), (F.col("l_suppkey") % 2).cast("string").alias("version"), F.col("l_linenumber").cast("int").alias("attempts"))
    return upkeep.reset_outdated(rows, F.col("version"), "1").drop("version")


@query("""
SELECT s.o_orderkey, s.p, CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN NOT o.parsed THEN 'unparsed' ELSE 'changed' END AS why
FROM (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS p FROM orders) s
LEFT JOIN (SELECT o_orderkey, o_totalprice AS p, o_orderpriority <> '2-HIGH' AS parsed FROM orders WHERE o_orderstatus <> 'P') o USING (o_orderkey) WHERE o.o_orderkey IS NULL OR NOT o.parsed OR s.p <> o.p""")
def retry_unparsed(t):
    old = t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_totalprice").alias("p"), (F.col("o_orderpriority") != "2-HIGH").alias("parsed"))
    scan = t.orders.select("o_orderkey", (F.col("o_totalprice") + F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("p"))
    return upkeep.changed_or_unparsed(old, scan, "o_orderkey", ["p"], "parsed")


@query("""
SELECT 'orders' AS kind, o_custkey AS owner, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 2
UNION ALL SELECT 'customer', c_custkey, count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 2""")
def cascade_delete(t):
    left = upkeep.cascade(t.customer.filter("c_mktsegment = 'BUILDING'"), "c_custkey", {"orders": (t.orders, "o_custkey"), "customer": (t.customer, "c_custkey")})
    counts = [left[kind].groupBy(F.col(column).alias("owner")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "owner", "n") for kind, column in (("orders", "o_custkey"), ("customer", "c_custkey"))]
    return counts[0].unionByName(counts[1])


@query("""
SELECT w.p_brand, w.title, o.first FROM (SELECT p_brand, max(p_name) AS title FROM part WHERE p_size > 10 GROUP BY 1) w LEFT JOIN (SELECT p_brand, min(p_partkey) AS first FROM part WHERE p_size < 40 GROUP BY 1) o USING (p_brand)""")
def dimension_sync(t):
    old = t.part.filter("p_size < 40").groupBy("p_brand").agg(F.min("p_name").alias("title"), F.min("p_partkey").alias("first"))
    return upkeep.sync_dimension(old, t.part.filter("p_size > 10").groupBy("p_brand").agg(F.max("p_name").alias("title")), "p_brand")


@query("""
SELECT p_partkey, CASE WHEN l_partkey IS NOT NULL AND p_size >= 10 THEN 'found ' || l_partkey ELSE p_name END AS title, CASE WHEN l_partkey IS NOT NULL AND p_size >= 10 THEN n ELSE p_size END AS score
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey""")
def manual_precedence(t):
    """What a person decided (here: of small parts) stays; an automatic pass gives the rest."""
    old = t.part.select("p_partkey", F.col("p_name").alias("title"), F.col("p_size").cast("long").alias("score"))
    found = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("score")).withColumn("title", F.concat(F.lit("found "), F.col("p_partkey").cast("string")))
    return upkeep.keep_manual(old, found, "p_partkey", F.col("o.score") < 10, ["title", "score"])


@query("""
SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND value >= 20""")
def manual_override(t):
    """The last report of each user and series; one below 20 takes it back."""
    return upkeep.latest_state(t.events, ["user_id", "event_type"], ["ts", "event_id"], F.col("value") < 20).select("user_id", "event_type", "value")


@query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS nickname, CASE WHEN c_nationkey < 10 THEN coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, 'none') ELSE CASE WHEN c_acctbal > 0 THEN c_name END END AS title, CAST(greatest(c_nationkey, 10) AS INTEGER) AS version FROM customer")
def schema_backfill(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("title"), F.col("c_nationkey").cast("int").alias("version"))
    wide = upkeep.with_columns_of(rows, {"c_custkey": "long", "nickname": "string", "title": "string", "version": "int"})
    return upkeep.backfill(wide, "version", 10, {"title": F.lit("none")})


_FROM = "'D:\\Media\\' || p_type || '\\' || p_brand || '/' || p_name"


def _paths(t):
    return t.part.select("p_partkey", F.concat(F.lit("D:\\Media\\"), "p_type", F.lit("\\"), "p_brand", F.lit("/"), "p_name").alias("path"))


def _mappings(t):
    by_maker = t.part.filter("p_type NOT LIKE '%E%'").select(F.concat(F.lit("d:/media/"), "p_type").alias("source"), F.concat(F.lit("/srv/"), "p_type").alias("target"))
    by_brand = t.part.filter("p_brand like '%1'").select(F.concat(F.lit("D:\\MEDIA/"), "p_type", F.lit("\\"), "p_brand", F.lit("\\")).alias("source"), F.concat(F.lit("/brands/"), "p_brand", F.lit("/")).alias("target"))
    return by_maker.unionByName(by_brand).distinct()


_NEW = "CASE WHEN p_brand LIKE '%1' THEN '/brands/' || p_brand || '/' || p_name WHEN p_type NOT LIKE '%E%' THEN '/srv/' || p_type || '/' || p_brand || '/' || p_name END"


@query(f"SELECT p_partkey, {_NEW} AS new_path FROM part")
def path_remap_table(t):
    return paths.remap(_paths(t), _mappings(t), "path").select("p_partkey", "new_path")


@query(f"SELECT count({_NEW}) AS rewritten, count(*) - count({_NEW}) AS untouched, CAST(coalesce((SELECT sum(n) FROM (SELECT count(DISTINCT {_FROM}) AS n FROM part WHERE {_NEW} IS NOT NULL GROUP BY {_NEW} HAVING count(DISTINCT {_FROM}) > 1)), 0) AS BIGINT) AS clashes FROM part")
def path_rewrite_dry_run(t):
    return paths.rewrite_report(paths.remap(_paths(t), _mappings(t), "path"), "path")


@query("SELECT c_custkey, lower(nfc_normalize('Vide' || chr(769) || 'os/' || c_name)) AS key, 'Vid' || chr(233) || 'os' = nfc_normalize('Vide' || chr(769) || 'os') AND c_custkey > 0 AS same FROM customer")
def path_keys(t):
    decomposed = F.concat(F.lit("Vide\u0301os/"), "c_name")
    return t.customer.select("c_custkey", text.path_key(decomposed).alias("key"), ((text.nfc(F.regexp_extract(decomposed, "^[^/]*", 0)) == "Vidéos") & (F.col("c_custkey") > 0)).alias("same"))


@query("SELECT o_orderkey, ready, ready OR o_orderdate < gate AS visible FROM (SELECT o_orderkey, o_orderdate, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_custkey || '-' || o_orderkey END, '') = o_custkey || '-' || CASE WHEN o_orderpriority = '2-HIGH' THEN 0 ELSE o_orderkey END AS ready, (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F') AS gate FROM orders)")
def visible_by_gate(t):
    """Ready by fingerprint, where unknown is unlike all; or older than a gate, which is one value."""
    gate = t.orders.filter("o_orderstatus = 'F'").agg(F.max("o_orderdate").alias("gate"))
    have = F.when(F.col("o_orderstatus") != "P", F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")))
    want = F.concat_ws("-", F.col("o_custkey").cast("string"), F.when(F.col("o_orderpriority") == "2-HIGH", 0).otherwise(F.col("o_orderkey")).cast("string"))
    rows = t.orders.crossJoin(F.broadcast(gate)).withColumn("ready", F.coalesce(have, F.lit("")) == want)
    return rows.select("o_orderkey", "ready", (F.col("ready") | (F.col("o_orderdate") < F.col("gate"))).alias("visible"))


@query("""
WITH f AS (SELECT p_partkey, concat('/media/', p_brand, '/', p_type, '/', p_partkey, '.mkv') AS path, p_size % 7 > 0 AS present, p_size FROM part),
u AS (SELECT '/media/' || p_brand AS above FROM part GROUP BY p_brand HAVING min(p_retailprice) < 902 UNION SELECT concat('/media/', p_brand, '/', p_type) FROM part GROUP BY p_brand, p_type HAVING max(p_size) < 48)
SELECT p_partkey, path, CASE WHEN p_size % 4 > 0 AND (SELECT count(*) FROM u WHERE starts_with(path, above || '/')) = 0 THEN true WHEN (SELECT count(*) FROM u WHERE starts_with(path, above || '/')) > 0 THEN present ELSE false END AS present FROM f""")
def guarded_merge(t):
    """Files after a walk that could not list some brands and some of their folders: what is below these keeps its flag."""
    path = F.concat(F.lit("/media/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".mkv"))
    old = t.part.select("p_partkey", path.alias("path"), (F.col("p_size") % 7 > 0).alias("present"))
    brand = F.concat(F.lit("/media/"), "p_brand")
    brands = t.part.groupBy("p_brand").agg(F.min("p_retailprice").alias("x")).filter("x < 902").select(brand.alias("path"))
    deeper = t.part.groupBy("p_brand", "p_type").agg(F.max("p_size").alias("x")).filter("x < 48").select(F.concat(brand, F.lit("/"), "p_type").alias("path"))
    broken = brands.union(deeper).select("path", F.lit("no rights").alias("error"))
    read = t.part.filter("p_size % 4 > 0").select(path.alias("path"))
    below = F.array(F.substring_index("path", "/", 3), F.substring_index("path", "/", 4))
    hidden = read.select("path", F.explode(below).alias("above")).join(broken.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    walked = read.join(hidden, "path", "left_anti").select("path", F.lit(None).cast("string").alias("error")).unionByName(broken)
    return folders.mark_gone(old, walked)
