"""Intervals over event times (seconds from the first of January) and order values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals
from ._registry import query

_SEC = "epoch(ts) - 1704067200"


def points(t):
    seconds = (F.unix_micros(F.to_timestamp_ltz("ts")) / 1000000) - 1704067200
    return t.events.select("event_id", "user_id", "event_type", seconds.alias("sec"))


@query("""
WITH o AS (SELECT o_orderkey, (o_orderkey % 60) + 0.5 AS d FROM orders),
e AS (SELECT o_orderkey, d, CAST(i AS INTEGER) AS i, CASE WHEN i <= 3 THEN i * 2.0 ELSE 6.0 + (i - 3) * 4.0 END AS s, CASE WHEN i < 3 THEN 2.0 ELSE 4.0 END AS w FROM o, range(0, 40) r(i))
SELECT o_orderkey, i AS index, CAST(s AS DOUBLE) AS start, CAST(least(w, d - s) AS DOUBLE) AS duration FROM e WHERE s < d - 0.001""")
def tiling_head_tail(t):
    d = (F.col("o_orderkey") % 60) + 0.5
    return t.orders.select("o_orderkey", F.inline(intervals.tiling(d)))


@query("""
WITH o AS (SELECT o_orderkey, (o_orderkey % 60) + 0.5 AS d FROM orders), k AS (SELECT *, CAST(ceil((d - 0.001) / 8) AS BIGINT) AS n FROM o),
m AS (SELECT *, CASE WHEN n > 1 AND d - (n - 1) * 8 < 1 THEN n - 1 ELSE n END AS kept FROM k)
SELECT o_orderkey, CAST(i AS INTEGER) AS index, CAST(i * 8 AS DOUBLE) AS start, CAST(CASE WHEN i = kept - 1 THEN d ELSE (i + 1) * 8 END - i * 8 AS DOUBLE) AS duration FROM m, range(0, 10) r(i) WHERE i < kept""")
def tiling_merged_tail(t):
    d = (F.col("o_orderkey") % 60) + 0.5
    return t.orders.select("o_orderkey", F.inline(intervals.tiling_merged_tail(d)))


@query(f"""
WITH RECURSIVE p AS (SELECT user_id, {_SEC} AS sec FROM events), g AS (
  SELECT user_id, min(sec) AS s, CAST(0 AS INTEGER) AS i FROM p GROUP BY 1
  UNION ALL SELECT g.user_id, (SELECT min(p.sec) FROM p WHERE p.user_id = g.user_id AND p.sec - g.s >= 86400.0), g.i + 1 FROM g WHERE g.s IS NOT NULL)
SELECT user_id, i AS index, floor(s * 1000 + 0.5) / 1000 AS start, floor(greatest(0.0, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY i), 2592000.0) - s) * 1000 + 0.5) / 1000 AS duration FROM g WHERE s IS NOT NULL""")
def greedy_segments(t):
    return intervals.greedy_segments(points(t), "user_id", "sec", F.first(F.lit(2592000.0)), 86400.0)


@query("""
SELECT c.event_id, c.user_id, arg_max(v.event_id, v.ts) AS last_view FROM (SELECT * FROM events WHERE event_type = 'click') c
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = c.user_id AND v.ts <= c.ts GROUP BY 1, 2""")
def asof_segment(t):
    e = t.events
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view"))
    return intervals.asof(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "last_view").select("event_id", "user_id", "last_view")


@query(f"""
WITH p AS (SELECT event_id, user_id, event_type, {_SEC} AS sec FROM events)
SELECT c.event_id, round(arg_min(v.sec, struct_pack(d := abs(v.sec - c.sec), t := v.sec)), 3) AS nearest FROM p c JOIN p v ON v.user_id = c.user_id AND v.event_type = 'view' WHERE c.event_type = 'error' GROUP BY 1""")
def nearest_boundary(t):
    p = points(t)
    found = intervals.nearest(p.filter("event_type = 'error'"), p.filter("event_type = 'view'").select("user_id", "sec"), ["user_id"], "sec")
    return found.filter("nearest is not null").select("event_id", F.round("nearest", 3).alias("nearest"))


@query("""
WITH s AS (SELECT DISTINCT l_suppkey AS root, CAST(l_quantity AS BIGINT) * (1 + l_suppkey % 3) // 2 - 1 AS i FROM lineitem)
SELECT root, (SELECT min(k) FROM range(0, 100) r(k) WHERE k NOT IN (SELECT i FROM s x WHERE x.root = s.root)) AS first_gap FROM s GROUP BY root""")
def first_gap(t):
    index = F.floor(F.floor("l_quantity") * (1 + F.col("l_suppkey") % 3) / 2).cast("long") - 1
    return intervals.first_gap(t.lineitem.select(F.col("l_suppkey").alias("root"), index.alias("i")), "root", "i")


@query(f"""
WITH p AS (SELECT user_id, event_id, {_SEC} AS sec FROM events), m AS (SELECT user_id, max(sec) AS pos FROM p GROUP BY 1)
SELECT event_id, p.user_id FROM p JOIN m ON m.user_id = p.user_id WHERE sec < pos - 30 * 3600""")
def retention_prune(t):
    p = points(t)
    last = p.groupBy("user_id").agg(F.max("sec").alias("pos"))
    return p.join(last, "user_id").filter(F.col("sec") < F.col("pos") - 30 * 3600).select("event_id", "user_id")


@query("SELECT user_id, event_id, round(lead(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch(ts), 3) AS gap FROM events")
def difference_to_next(t):
    rows = intervals.to_next(points(t).select("user_id", "event_id", "sec"), ["user_id"], ["sec", "event_id"], "sec", "gap")
    return rows.select("user_id", "event_id", F.round("gap", 3).alias("gap"))


@query(f"SELECT user_id, count(*) FILTER (sec < 864000 - 0.001) AS before, count(*) AS segments FROM (SELECT user_id, {_SEC} AS sec FROM events) GROUP BY 1")
def count_segments_before(t):
    return points(t).groupBy("user_id").agg(F.count_if(F.col("sec") < 864000 - 0.001).alias("before"), F.count("*").alias("segments"))


@query("""
WITH w AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2) SELECT * FROM w""")
def tumbling_daily(t):
    w = F.window("ts", "1 day")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")
