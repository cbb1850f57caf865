"""Feeds and rankings: latest state, what comes next, rolling means, ranks, queues.

``events`` stand for progress reports: ``user_id`` watches the item ``event_id % 40`` of
series ``event_type``; ``value`` is the position in an item of 100 seconds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio_of
from ..operators import fold
from ..operators.progress import continue_feed, next_item
from ..operators.relational import top_per_group
from ..scratch import shared
from ..streaming.keyed import ResumeFeed
from ._registry import Tables, query

NOW = "2024-02-01 00:00:00"
DURATION = 100.0


def states(t: Tables) -> DataFrame:
    """Latest state of each user and item, from all reports, in one aggregate."""
    e = t.events.select("user_id", F.col("event_type").alias("series"), (F.col("event_id") % 40).alias("item"), "ts", "value")
    return e.groupBy("user_id", "series", "item").agg(F.max_by(F.struct("ts", "value"), "ts").alias("s")).select(
        "user_id", "series", "item", F.col("s.value").alias("position"), F.col("s.ts").alias("updated"), (F.col("s.value") >= 0.9 * DURATION).alias("watched"))


_STATES = """states AS (SELECT user_id, event_type AS series, event_id % 40 AS item, max_by(value, ts) AS position, max(ts) AS updated, max_by(value, ts) >= 90.0 AS watched FROM events GROUP BY 1, 2, 3)"""
_LATEST = "latest AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY user_id, series ORDER BY updated DESC, item DESC) = 1)"


@query(f"WITH {_STATES}, {_LATEST} SELECT user_id, series, item, position, updated FROM latest")
def resume_latest_per_show(t):
    return top_per_group(states(t), ["user_id", "series"], [F.desc("updated"), F.desc("item")]).select("user_id", "series", "item", "position", "updated")


@query(f"""
WITH {_STATES}, {_LATEST}
SELECT l.user_id, l.series, min(s.item) AS next_item FROM latest l JOIN states s ON s.user_id = l.user_id AND s.series = l.series AND s.item > l.item AND NOT s.watched WHERE l.watched GROUP BY 1, 2""")
def resume_next_after(t):
    return next_item(states(t), ["user_id", "series"], "item").select("user_id", "series", F.col("next").alias("next_item"))


@query(f"""
WITH {_STATES}, {_LATEST}, fresh AS (SELECT * FROM latest WHERE updated >= TIMESTAMP '{NOW}' - INTERVAL 182 DAY)
SELECT user_id, series, item, 'resume' AS kind, updated FROM fresh WHERE NOT watched AND position >= 5.0
UNION ALL
SELECT f.user_id, f.series, s.item, 'next', s.updated FROM fresh f JOIN states s ON s.user_id = f.user_id AND s.series = f.series AND s.item > f.item AND NOT s.watched WHERE f.watched
QUALIFY row_number() OVER (PARTITION BY f.user_id, f.series ORDER BY s.item) = 1""")
def continue_feed_union(t):
    return continue_feed(states(t), ["user_id", "series"], "item", DURATION, NOW).select("user_id", "series", "item", "kind", "updated")


@query(f"""
WITH {_STATES}, {_LATEST}, fresh AS (SELECT * FROM latest WHERE updated >= TIMESTAMP '{NOW}' - INTERVAL 182 DAY)
SELECT user_id, series, item, 'resume' AS kind, updated FROM fresh WHERE NOT watched AND position >= 5.0
UNION ALL
SELECT f.user_id, f.series, s.item, 'next', s.updated FROM fresh f JOIN states s ON s.user_id = f.user_id AND s.series = f.series AND s.item > f.item AND NOT s.watched WHERE f.watched
QUALIFY row_number() OVER (PARTITION BY f.user_id, f.series ORDER BY s.item) = 1""")
def feed_upkeep(t):
    """The feed kept up by three batches of reports, each of which rewrites the buckets it touches: the same as from all reports at once."""
    feed = ResumeFeed(t.spark, f"{shared(t.spark)}/feed-{uuid.uuid4().hex}", DURATION, buckets=16)
    reports = t.events.select("user_id", F.col("event_type").alias("series"), (F.col("event_id") % 40).alias("item"), "ts", "value")
    day = F.dayofmonth("ts")
    for number, batch in enumerate((day <= 10, (day > 10) & (day <= 20), day > 20)):
        feed.take(reports.filter(batch), number)
    return feed.entries(NOW).select("user_id", "series", "item", "kind", "updated")


@query("""
SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rate FROM events""")
def rolling5_throughput(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return t.events.select("event_id", "user_id", F.round(F.avg("value").over(w), 6).alias("rate"))


@query("""
WITH a AS (SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN n > 1 THEN role || ' (' || turn % 2 || ')' ELSE role END AS label FROM a)
SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id, label) > 1 THEN label || ' #' || turn ELSE label END AS label FROM b""")
def label_disambiguation(t):
    """Equal labels get a detail; those still equal get their number."""
    n = lambda *keys: F.count("*").over(Window.partitionBy(*keys))
    a = t.conversations.select("conv_id", "turn", "role").withColumn("n", n("conv_id", "role"))
    label = F.when(F.col("n") > 1, F.concat("role", F.lit(" ("), (F.col("turn") % 2).cast("string"), F.lit(")"))).otherwise(F.col("role"))
    b = a.select("conv_id", "turn", label.alias("label"))
    last = F.when(n("conv_id", "label") > 1, F.concat("label", F.lit(" #"), F.col("turn").cast("string"))).otherwise(F.col("label"))
    return b.select("conv_id", "turn", last.alias("label"))


@query("""
SELECT source, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, n_chars DESC, doc_id) = 1""")
def best_logo_rank(t):
    wanted = F.when(F.col("lang") == "fr", 0).when(F.col("lang") == "en", 1).otherwise(2)
    return top_per_group(t.documents.select("source", "doc_id", "lang", "n_chars"), ["source"], [wanted, F.desc("n_chars"), "doc_id"]).select("source", "doc_id", "lang")


@query("""
SELECT work, person, place FROM (
  SELECT work, person, row_number() OVER (PARTITION BY work ORDER BY o, person) AS place FROM (
    SELECT l_orderkey AS work, l_partkey AS person, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2)) WHERE place <= 6""")
def cast_top6_dedupe(t):
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("person")).agg(F.min("l_linenumber").alias("o"))
    return top_per_group(first, ["work"], ["o", "person"], 6, rank="place").select("work", "person", F.col("place").cast("long").alias("place"))


@query("""
SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_totalprice, o_orderkey) AS BIGINT) AS place FROM orders WHERE o_orderstatus = 'P' ORDER BY place LIMIT 40""")
def queue_claim_order(t):
    """The claim order is a sort with a limit; only its result is numbered."""
    head = t.orders.filter("o_orderstatus = 'P'").orderBy(F.desc("o_orderdate"), "o_totalprice", "o_orderkey").limit(40)
    w = Window.orderBy(F.desc("o_orderdate"), "o_totalprice", "o_orderkey")
    return head.withColumn("place", F.row_number().over(w).cast("long")).select("o_orderkey", "o_orderpriority", "place").orderBy("place")


@query("""
SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER w, first_value(o_orderkey) OVER w) AS successor FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def successor_with_wrap(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.coalesce(F.lead("o_orderkey").over(w), F.first("o_orderkey").over(w)).alias("successor"))


@query("""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT k, user_id, event_id, ts, value, true AS sent, value AS v, ts AS at FROM e WHERE k = 1
  UNION ALL SELECT e.k, e.user_id, e.event_id, e.ts, e.value, abs(e.value - s.v) >= 5 AND e.ts >= s.at + INTERVAL 10 SECOND,
    CASE WHEN abs(e.value - s.v) >= 5 AND e.ts >= s.at + INTERVAL 10 SECOND THEN e.value ELSE s.v END,
    CASE WHEN abs(e.value - s.v) >= 5 AND e.ts >= s.at + INTERVAL 10 SECOND THEN e.ts ELSE s.at END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT event_id, user_id, ts FROM s WHERE sent""")
def event_throttle(t):
    """Reports that moved by 5 at least, 10 s or more after the last one let through."""
    return fold.throttled(t.events.select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value", seconds=10, moved=5, tie="event_id").select("event_id", "user_id", "ts")


@query("""
SELECT event_id, round(CASE WHEN value > 0 THEN least(1.0, value / 100.0) ELSE 0.0 END, 6) AS ratio,
 CASE WHEN value / 100.0 >= 0.9 THEN 'finished' WHEN value / 100.0 >= 0.05 THEN 'started' ELSE 'untouched' END AS state FROM events""")
def ratio_thresholds(t):
    r = ratio_of(F.col("value"), F.lit(DURATION))
    return t.events.select("event_id", F.round(r, 6).alias("ratio"), F.when(r >= 0.9, "finished").when(r >= 0.05, "started").otherwise("untouched").alias("state"))


@query("""
SELECT u.user_id, coalesce(a.kind, b.kind, 'none') AS kind, coalesce(a.id, b.id) AS preference FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN (SELECT user_id, 'own' AS kind, max(event_id) AS id FROM events WHERE event_type = 'signup' AND value > 200 GROUP BY 1) a USING (user_id)
LEFT JOIN (SELECT 'global' AS kind, max(event_id) AS id FROM events WHERE event_type = 'signup' AND user_id = 0) b ON true""")
def scope_fallback_preference(t):
    """A preference of one's own, whole, or else the one for all."""
    e = t.events
    own = e.filter("event_type = 'signup' AND value > 200").groupBy("user_id").agg(F.max("event_id").alias("own"))
    shared = e.filter("event_type = 'signup' AND user_id = 0").agg(F.max("event_id").alias("shared")).withColumn("one", F.lit(1))
    rows = e.select("user_id").distinct().join(own, "user_id", "left").withColumn("one", F.lit(1)).join(F.broadcast(shared), "one")
    choice = F.coalesce(F.when(F.col("own").isNotNull(), F.struct(F.lit("own").alias("kind"), F.col("own").alias("preference"))), F.struct(F.lit("global").alias("kind"), F.col("shared").alias("preference")))
    return rows.select("user_id", choice.alias("c")).select("user_id", "c.kind", "c.preference")


@query("SELECT conv_id, turn, text FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn) AS k FROM conversations WHERE trim(text) <> '') WHERE k = 1")
def first_by_preference(t):
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return top_per_group(t.conversations.filter("trim(text) <> ''"), ["conv_id"], [rank, "turn"]).select("conv_id", "turn", "text")


@query("SELECT user_id, series, CAST(count(*) FILTER (watched) AS BIGINT) AS seen, count(*) AS items, CASE WHEN count(*) FILTER (NOT watched) = 0 THEN true ELSE false END AS complete FROM (WITH " + _STATES + " SELECT * FROM states) GROUP BY 1, 2")
def watched_counts(t):
    return states(t).groupBy("user_id", "series").agg(F.count_if("watched").alias("seen"), F.count("*").alias("items"), F.bool_and("watched").alias("complete"))
