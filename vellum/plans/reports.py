"""Reports: distributions, pivots, scorecards, coverage, queue state and estimates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.relational import by_groups, distribution, percent, pivot_counts
from ._registry import query

_PCT = "CASE WHEN {1} = 0 THEN 0.0 ELSE floor(1000.0 * {0} / {1} + 0.5) / 10 END"


@query(f"SELECT value, n, {_PCT.format('n', 'sum(n) OVER ()')} AS percent FROM (SELECT coalesce(CASE WHEN p_size % 7 <> 0 THEN p_type END, '(unknown)') AS value, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, value")
def distribution_with_unknown(t):
    return distribution(t.part, F.when(F.col("p_size") % 7 != 0, F.col("p_type"))).orderBy(F.desc("n"), "value")


@query("""
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN p_size IS NULL THEN '(unknown)' WHEN p_size * 50 >= 2000 THEN '4K' WHEN p_size * 50 >= 1300 THEN 'QHD'
  WHEN p_size * 50 >= 1000 THEN 'FHD' WHEN p_size * 50 >= 700 THEN 'HD' ELSE 'SD' END AS bucket FROM part) GROUP BY 1""")
def resolution_buckets(t):
    height = F.col("p_size") * 50
    bucket = F.when(height.isNull(), "(unknown)").when(height >= 2000, "4K").when(height >= 1300, "QHD").when(height >= 1000, "FHD").when(height >= 700, "HD").otherwise("SD")
    return t.part.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""
SELECT count(*) FILTER (l_discount > 0.05) AS discount, count(*) FILTER (l_tax > 0.04) AS tax, count(*) FILTER (l_quantity > 40) AS quantity,
       count(*) FILTER (l_discount > 0.05 AND l_tax > 0.04) AS discount_and_tax, count(*) AS total FROM lineitem""")
def blockers_pivot(t):
    d, x, q = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, F.col("l_quantity") > 40
    return t.lineitem.agg(F.count_if(d).alias("discount"), F.count_if(x).alias("tax"), F.count_if(q).alias("quantity"), F.count_if(d & x).alias("discount_and_tax"), F.count("*").alias("total"))


@query("""
SELECT kind, count(*) AS orders, max(tracks) AS most FROM (
  SELECT o_orderkey, count(l_orderkey) AS tracks, CASE WHEN count(l_orderkey) = 0 THEN 'none' WHEN count(*) FILTER (l_returnflag = 'R') = count(l_orderkey) THEN 'image'
    WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'text' ELSE 'mixed' END AS kind FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1""")
def track_mix_two_level(t):
    per = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("tracks"), F.count_if(F.col("l_returnflag") == "R").alias("images"))
    kind = F.when(F.col("tracks") == 0, "none").when(F.col("images") == F.col("tracks"), "image").when(F.col("images") == 0, "text").otherwise("mixed")
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("orders"), F.max("tracks").alias("most"))


@query("SELECT max(n) AS most, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS several FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)")
def max_tracks(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.agg(F.max("n").alias("most"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("several"))


@query("SELECT r_name, count(*) AS files, round(sum(l_quantity) / 3600, 4) AS hours, CAST(floor(avg(l_quantity) + 0.5) AS BIGINT) AS mean_quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def duration_by_type(t):
    dims = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("s_suppkey", "r_name")
    rows = t.lineitem.join(dims, F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.groupBy("r_name").agg(F.count("*").alias("files"), F.round(F.sum("l_quantity") / 3600, 4).alias("hours"), F.floor(F.avg("l_quantity") + 0.5).cast("long").alias("mean_quantity"))


@query("SELECT count(DISTINCT o_custkey) AS shows, count(DISTINCT (o_custkey, year(o_orderdate))) AS seasons, count(DISTINCT o_orderkey) AS episodes FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def distinct_multi(t):
    rows = t.orders.join(t.lineitem.select("l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return rows.agg(F.count_distinct("o_custkey").alias("shows"), F.count_distinct(F.struct("o_custkey", F.year("o_orderdate"))).alias("seasons"), F.count_distinct("o_orderkey").alias("episodes"))


@query("SELECT p_name, count(*) AS n, string_agg(p_partkey || ' (' || p_size || ')', ' | ' ORDER BY p_partkey) AS variants FROM part GROUP BY 1 HAVING count(*) > 1")
def homonyms_having(t):
    label = F.concat(F.col("p_partkey").cast("string"), F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))
    grouped = t.part.groupBy("p_name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("p_partkey", label.alias("v")))).alias("all")).filter("n > 1")
    return grouped.select("p_name", "n", F.array_join(F.transform("all", lambda x: x["v"]), " | ").alias("variants"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies, count(DISTINCT l_suppkey) AS roots FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1")
def duplicates_across_roots(t):
    rows = by_groups(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey", "l_linenumber")
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"), F.count_distinct("l_suppkey").alias("roots")).filter("roots > 1")


@query("SELECT count(*) AS silent FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag <> 'R') = 0)")
def all_null_groups(t):
    codec = F.when(F.col("l_returnflag") != "R", F.col("l_returnflag"))
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(codec.isNull()).alias("unknown")).filter("n = unknown").agg(F.count("*").alias("silent"))


@query("""
SELECT (SELECT count(*) FROM part) AS works, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_linestatus = 'O') AS with_files,
       (SELECT count(*) FROM customer) AS shows, (SELECT count(DISTINCT o_custkey) FROM orders) AS with_episodes,
       (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels WHERE quality = 1) AS good""")
def scorecard_one_row(t):
    """One row of counts; each table is scanned once and sends one row."""
    parts = [
        t.part.agg(F.count("*").alias("works")), t.lineitem.agg(F.count_distinct(F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))).alias("with_files")),
        t.customer.agg(F.count("*").alias("shows")), t.orders.agg(F.count_distinct("o_custkey").alias("with_episodes")),
        t.documents.agg(F.count("*").alias("documents")), t.labels.agg(F.count_if(F.col("quality") == 1).alias("good")),
    ]
    out = parts[0].withColumn("__one", F.lit(1))
    for p in parts[1:]:
        out = out.join(F.broadcast(p.withColumn("__one", F.lit(1))), "__one")
    return out.drop("__one")


@query(f"SELECT lang, count(*) AS total, count(l.doc_id) AS labelled, {_PCT.format('count(l.doc_id)', 'count(*)')} AS percent FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def coverage_ratio(t):
    rows = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("total"), F.count("hit").alias("labelled")).withColumn("percent", percent(F.col("labelled"), F.col("total")))


@query("SELECT o_orderpriority AS queue, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) AS total FROM orders GROUP BY 1")
def queue_status_pivot(t):
    return pivot_counts(t.orders.withColumnRenamed("o_orderpriority", "queue"), "o_orderstatus", ["O", "F", "P"], ["queue"])


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def group_by_two_keys(t):
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""
SELECT count(*) AS files, count(*) FILTER (l_returnflag = 'N') AS done, round(sum(l_extendedprice), 2) AS bytes, round(coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'N'), 0), 2) AS bytes_done
FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O')""")
def progress_totals(t):
    rows = t.lineitem.join(t.orders.filter("o_orderstatus = 'O'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    done = F.col("l_returnflag") == "N"
    return rows.agg(F.count("*").alias("files"), F.count_if(done).alias("done"), F.round(F.sum("l_extendedprice"), 2).alias("bytes"), F.round(F.sum(F.when(done, F.col("l_extendedprice")).otherwise(0.0)), 2).alias("bytes_done"))


@query("""
WITH rates AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS rate, s_nationkey FROM supplier),
waiting AS (SELECT l_suppkey, sum(l_extendedprice) AS b FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT s_nationkey AS nation, count(*) AS roots, CASE WHEN count(rate) = count(*) THEN round(sum(b / rate), 2) END AS eta FROM waiting JOIN rates ON s_suppkey = l_suppkey GROUP BY 1""")
def eta_by_root(t):
    """Time left: waiting bytes over each root's rate; unknown if any rate is."""
    waiting = t.lineitem.filter("l_linestatus = 'O'").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("b"))
    rate = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))
    rows = waiting.join(t.supplier.select("s_suppkey", "s_nationkey", rate.alias("rate")), F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("roots"), F.when(F.count("rate") == F.count("*"), F.round(F.sum(F.col("b") / F.col("rate")), 2)).alias("eta"))


@query("""
SELECT l_partkey AS work, count(*) AS files, round(sum(l_extendedprice), 2) AS size, CAST(floor(avg(CASE WHEN l_tax > 0 THEN l_quantity END) + 0.5) AS BIGINT) AS bitrate,
  round(sum(CASE WHEN l_discount > 0 THEN l_quantity END), 2) AS duration, list_sort(list(DISTINCT trim(l_returnflag))) AS codecs, min(l_shipdate) AS added,
  list_reverse_sort(list(DISTINCT CAST(l_quantity AS INTEGER))) AS heights FROM lineitem GROUP BY 1""")
def file_summary(t):
    """All of a work's file facts in one grouping: means and sums skip the unknown, sets are sorted."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("work")).agg(
        F.count("*").alias("files"), F.round(F.sum("l_extendedprice"), 2).alias("size"), F.floor(F.avg(F.when(F.col("l_tax") > 0, F.col("l_quantity"))) + 0.5).cast("long").alias("bitrate"),
        F.round(F.sum(F.when(F.col("l_discount") > 0, F.col("l_quantity"))), 2).alias("duration"), F.array_sort(F.collect_set(F.trim("l_returnflag"))).alias("codecs"), F.min("l_shipdate").alias("added"),
        F.reverse(F.array_sort(F.collect_set(F.col("l_quantity").cast("int")))).alias("heights"),
    )


@query("SELECT lang, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS BIGINT) AS longest FROM documents GROUP BY 1")
def text_sizes(t):
    return t.documents.groupBy("lang").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT l_suppkey AS root, count(*) AS failures, coalesce(max(CASE WHEN l_returnflag = 'R' THEN 'returned' END), '(no message)') AS message FROM lineitem GROUP BY 1 ORDER BY failures DESC, root LIMIT 20")
def recent_failures(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("root")).agg(F.count("*").alias("failures"), F.coalesce(F.max(F.when(F.col("l_returnflag") == "R", "returned")), F.lit("(no message)")).alias("message")).orderBy(F.desc("failures"), "root").limit(20)


@query("SELECT c_mktsegment AS genre, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) WHERE n >= 12 ORDER BY n DESC, genre LIMIT 4")
def threshold_top_k(t):
    return t.customer.groupBy(F.col("c_mktsegment").alias("genre")).agg(F.count("*").alias("n")).filter("n >= 12").orderBy(F.desc("n"), "genre").limit(4)


@query("""
SELECT l_orderkey AS o_orderkey, coalesce(list(l_partkey ORDER BY l_partkey) FILTER (l_returnflag = 'A'), []) AS directors, coalesce(list(l_partkey ORDER BY l_partkey) FILTER (l_returnflag = 'R'), []) AS creators
FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem) GROUP BY 1""")
def role_split_lists(t):
    """One list a role, from one grouping."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag").distinct()
    own = lambda flag: F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == flag, F.col("l_partkey"))))
    return rows.groupBy("o_orderkey").agg(own("A").alias("directors"), own("R").alias("creators"))


@query("""
SELECT bool_or(l_returnflag = 'R') AS any_ready, l_partkey AS work, min(l_orderkey) AS first_file, count(*) FILTER (l_linestatus = 'O') > 0 AS playable FROM lineitem GROUP BY l_partkey""")
def any_ready_per_group(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("work")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_ready"), F.min("l_orderkey").alias("first_file"), F.bool_or(F.col("l_linestatus") == "O").alias("playable"))


@query("""
SELECT o_orderkey AS work, CASE WHEN missing > 0 THEN missing || ' of ' || n || ' missing: ' || names END AS verdict FROM (
  SELECT o_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS missing, string_agg(CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS VARCHAR) END, ', ' ORDER BY l_linenumber) AS names
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def completeness_verdict(t):
    missing = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("work")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(missing)).alias("m"))
    text = F.concat(F.size("m").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" missing: "), F.array_join(F.transform("m", lambda x: x.cast("string")), ", "))
    return rows.select("work", F.when(F.size("m") > 0, text).alias("verdict"))


@query("SELECT reason, n FROM (SELECT CASE WHEN length(text) < 400 THEN 'too small' WHEN contains(text, '#') THEN 'symbols' WHEN contains(text, '!!') THEN 'shouting' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, reason")
def skip_reason_counters(t):
    reason = F.when(F.length("text") < 400, "too small").when(F.contains("text", F.lit("#")), "symbols").when(F.contains("text", F.lit("!!")), "shouting").otherwise("kept")
    return t.documents.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query("SELECT l_orderkey, CAST(floor(avg(m) + 0.5) AS BIGINT) AS mean_runtime FROM (SELECT l_orderkey, l_returnflag, max(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def mean_runtime(t):
    per = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.max("l_quantity").alias("m"))
    return per.groupBy("l_orderkey").agg(F.floor(F.avg("m") + 0.5).cast("long").alias("mean_runtime"))
