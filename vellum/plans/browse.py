"""Browsing: filtered and searched pages, counts, semi and anti joins, details.

``part`` stands for works, ``lineitem`` for their files (live if the line is open),
``supplier`` for roots, ``customer``/``orders`` for series and their episodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_all_words, sort_title, title_key
from ..operators.relational import exists_flag, page, semi
from ._registry import Tables, query

PAGE_SIZE = 50


def live_files(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_linestatus = 'O'")


def works_found(t: Tables, wanted: str = "") -> DataFrame:
    """Works with a live file, searched by words of their key."""
    works = t.part.withColumn("title_key", title_key(F.col("p_name")))
    if wanted:
        works = works.filter(contains_all_words(F.col("title_key"), wanted))
    return semi(works, live_files(t).select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


_KEY = "trim(regexp_replace(replace(translate(lower(strip_accents({0})), '''’`', ''), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_P_KEY = _KEY.format("p_name")


@query(f"""
SELECT p.p_partkey, p.p_name, {_P_KEY} AS title_key, count(*) AS file_count, count(DISTINCT l_suppkey) AS root_count
FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_linestatus = 'O'
WHERE {_P_KEY} LIKE '%blue%' AND {_P_KEY} LIKE '%o%'
GROUP BY ALL ORDER BY title_key, p_partkey LIMIT {PAGE_SIZE}""")
def browse_page(t):
    works = works_found(t, "blue o")
    counts = live_files(t).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("file_count"), F.count_distinct("l_suppkey").alias("root_count"))
    rows = works.join(counts, "p_partkey").select("p_partkey", "p_name", "title_key", "file_count", "root_count")
    return page(rows, ["title_key", "p_partkey"], 1, PAGE_SIZE)


@query(f"""
SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / {PAGE_SIZE}.0) AS BIGINT)) AS pages FROM part
WHERE {_P_KEY} LIKE '%blue%' AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linestatus = 'O')""")
def browse_total(t):
    total = F.count("*")
    return works_found(t, "blue").agg(total.alias("total"), F.greatest(F.lit(1).cast("long"), F.ceil(total / F.lit(float(PAGE_SIZE))).cast("long")).alias("pages"))


@query(f"SELECT p_partkey, p_name FROM part WHERE {_P_KEY} LIKE '%ring%' AND {_P_KEY} LIKE '%s%'")
def search_words(t):
    return t.part.filter(contains_all_words(title_key(F.col("p_name")), "ring s")).select("p_partkey", "p_name")


@query("""
SELECT r_regionkey, r_name, r_regionkey % 2 = 1 AS is_show, count(DISTINCT n_nationkey) AS roots, count(s_suppkey) AS works
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def libraries_counts(t):
    rows = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("r_regionkey", "r_name", (F.col("r_regionkey") % 2 == 1).alias("is_show")).agg(F.count_distinct("n_nationkey").alias("roots"), F.count("s_suppkey").alias("works"))


@query("""
SELECT p_brand AS genre, coalesce(a.n, 0) AS movies, coalesce(b.n, 0) AS shows, coalesce(a.n, 0) + coalesce(b.n, 0) AS total
FROM (SELECT DISTINCT p_brand FROM part)
LEFT JOIN (SELECT p_brand, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' GROUP BY 1) a USING (p_brand)
LEFT JOIN (SELECT p_brand, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1) b USING (p_brand)
ORDER BY total DESC, genre""")
def genres_two_sided_counts(t):
    """Each side is counted on its own: joining both at once would multiply them."""
    lines = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    side = lambda flag, key, name: lines.filter(F.col("l_returnflag") == flag).groupBy("p_brand").agg(F.count_distinct(key).alias(name))
    both = t.part.select("p_brand").distinct().join(side("A", "l_partkey", "movies"), "p_brand", "left").join(side("R", "l_orderkey", "shows"), "p_brand", "left").fillna(0, ["movies", "shows"])
    return both.select(F.col("p_brand").alias("genre"), "movies", "shows", (F.col("movies") + F.col("shows")).alias("total")).orderBy(F.desc("total"), "genre")


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS has_file FROM orders")
def work_flag_exists(t):
    return exists_flag(t.orders.select("o_orderkey"), live_files(t).select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"], "has_file")


@query("SELECT p_partkey, count(l_orderkey) AS files, min(l_shipdate) AS added FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_linestatus = 'O' GROUP BY 1")
def work_live_file_counts(t):
    return t.part.join(live_files(t), F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("p_partkey").agg(F.count("l_orderkey").alias("files"), F.min("l_shipdate").alias("added"))


@query("""
SELECT 'movie' AS kind, p_partkey AS id, p_name AS title FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_linestatus = 'O')
UNION ALL SELECT 'show', o_orderkey, NULL FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def orphans_anti(t):
    """Works without files, of two kinds, in one relation."""
    files = t.lineitem
    movies = t.part.join(files.filter("l_returnflag = 'R' AND l_linestatus = 'O'"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.lit("movie").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    shows = t.orders.join(files, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.lit("show").alias("kind"), F.col("o_orderkey").alias("id"))
    return movies.unionByName(shows, allowMissingColumns=True)


@query("""
SELECT event_id, event_type, user_id FROM events
WHERE (event_type = 'view' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 5000))
   OR (event_type = 'click' AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id AND s_acctbal > 5000))""")
def polymorphic_semi(t):
    """A type column says which table the key is of: one semi join for each type."""
    ids = t.events.select("event_id", "event_type", "user_id")
    a = semi(ids.filter("event_type = 'view'"), t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id")), ["user_id"])
    b = semi(ids.filter("event_type = 'click'"), t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("user_id")), ["user_id"])
    return a.unionByName(b).select("event_id", "event_type", "user_id")


@query("SELECT o_orderkey, count(l_partkey) AS tracks, count(DISTINCT l_returnflag) AS kinds FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'N' GROUP BY 1")
def left_zero_groups(t):
    return t.orders.join(t.lineitem.filter("l_returnflag <> 'N'"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_partkey").alias("tracks"), F.count_distinct("l_returnflag").alias("kinds"))


@query("""
SELECT event_id, coalesce(p_name, c_name, s_name, '(none)') AS title FROM events
LEFT JOIN part ON p_partkey = user_id AND event_type = 'view' LEFT JOIN customer ON c_custkey = user_id AND event_type = 'click'
LEFT JOIN supplier ON s_suppkey = user_id AND event_type = 'error'""")
def coalesce_titles_3left(t):
    e = t.events.select("event_id", "event_type", "user_id")
    on = lambda key, kind: (F.col(key) == F.col("user_id")) & (F.col("event_type") == kind)
    rows = e.join(t.part.select("p_partkey", "p_name"), on("p_partkey", "view"), "left").join(t.customer.select("c_custkey", "c_name"), on("c_custkey", "click"), "left").join(t.supplier.select("s_suppkey", "s_name"), on("s_suppkey", "error"), "left")
    return rows.select("event_id", F.coalesce("p_name", "c_name", "s_name", F.lit("(none)")).alias("title"))


@query("""
SELECT p_partkey, p_name, list_sort(list(DISTINCT l_returnflag)) AS flags FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY ALL""", name="ordered_set_per_work")
def ordered_set_per_work(t):
    return t.part.filter("p_size < 10").join(t.lineitem, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey", "p_name").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))


@query("SELECT p_brand, string_agg(p_name, ', ' ORDER BY p_name) AS names, count(*) AS n FROM (SELECT DISTINCT p_brand, p_name FROM part) GROUP BY 1")
def ordered_string_agg(t):
    return t.part.select("p_brand", "p_name").distinct().groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_name")), ", ").alias("names"), F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_size NULLS LAST, p_name DESC, p_partkey LIMIT 50 OFFSET 100")
def page_offset_stable(t):
    return page(t.part, ["p_size", F.desc("p_name"), "p_partkey"], 3, PAGE_SIZE).select("p_partkey", "p_name")


@query("""
SELECT p_partkey, p_name, p_size FROM part WHERE p_brand = (SELECT p_brand FROM part WHERE p_partkey = 7) AND p_partkey <> 7 ORDER BY p_size DESC, p_partkey LIMIT 20""")
def suggestions_exclude_self(t):
    mine = t.part.filter("p_partkey = 7").select("p_brand")
    return semi(t.part.filter("p_partkey <> 7"), mine, ["p_brand"]).orderBy(F.desc("p_size"), "p_partkey").limit(20).select("p_partkey", "p_name", "p_size")


@query(r"""
SELECT c_custkey, list(struct_pack(year := y, orders := n, total := s) ORDER BY y) AS seasons FROM (
  SELECT o_custkey AS c_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1, 2) GROUP BY 1""")
def nested_show_document(t):
    """Series with their seasons, nested; two groupings, no join back."""
    seasons = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return seasons.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("year", "orders", "total"))).alias("seasons"))


@query("""
SELECT p_partkey, p_name, year_added FROM (SELECT p_partkey, p_name, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 1990 + p_size END AS year_added FROM part)
ORDER BY year_added IS NULL, year_added DESC, p_partkey LIMIT 50""")
def nulls_last_both_ways(t):
    rows = t.part.select("p_partkey", "p_name", F.when(F.col("p_size") % 5 != 0, 1990 + F.col("p_size")).alias("year_added"))
    return rows.orderBy(F.col("year_added").isNull(), F.desc("year_added"), "p_partkey").limit(50)


@query("SELECT c_custkey, c_name FROM customer ORDER BY lower(c_mktsegment), c_name DESC, c_custkey LIMIT 30")
def nocase_sort(t):
    return t.customer.orderBy(F.collate("c_mktsegment", "UTF8_LCASE"), F.desc("c_name"), "c_custkey").limit(30).select("c_custkey", "c_name")


@query("""
SELECT region_id, root_id, name FROM (
  SELECT r_regionkey AS region_id, n_nationkey AS root_id, n_name AS name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name, n_nationkey) AS k
  FROM region JOIN nation ON n_regionkey = r_regionkey) WHERE k <= 3""")
def cap_inside_group(t):
    from ..operators.relational import top_per_group

    rows = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").alias("region_id"), F.col("n_nationkey").alias("root_id"), F.col("n_name").alias("name"))
    return top_per_group(rows, ["region_id"], ["name", "root_id"], 3)


@query("SELECT p_partkey, p_name, year FROM (SELECT p_partkey, p_name, 1990 + p_size AS year FROM part) WHERE p_partkey = 42")
def point_lookup(t):
    return t.part.filter("p_partkey = 42").limit(1).select("p_partkey", "p_name", (1990 + F.col("p_size")).alias("year"))


_SORT = f"CASE WHEN regexp_replace({_P_KEY}, '^(the|a|an|le|la|les|un|une|des|l)\\s+', '') = '' THEN {_P_KEY} ELSE regexp_replace({_P_KEY}, '^(the|a|an|le|la|les|un|une|des|l)\\s+', '') END"


@query(f"SELECT p_partkey, {_SORT} AS sort_title FROM (SELECT p_partkey, 'The ' || p_name AS p_name FROM part)", name="sort_title")
def sort_title_query(t):
    return t.part.select("p_partkey", sort_title(F.concat(F.lit("The "), F.col("p_name"))).alias("sort_title"))


@query(f"SELECT doc_id, {_KEY.format('text')} AS title_key FROM documents", name="title_key")
def title_key_query(t):
    return t.documents.select("doc_id", title_key(F.col("text")).alias("title_key"))
