"""Searches by postings and deep pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import paging, search
from ..operators.relational import spread
from ._registry import query


@query("""
WITH k AS (SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || ' ' || lower(c_mktsegment) AS key FROM customer),
s AS (SELECT s_suppkey AS sid, [substring(printf('%05d', s_suppkey), 2, 4), CASE s_nationkey % 4 WHEN 0 THEN 'build' WHEN 1 THEN 'ch' WHEN 2 THEN 'e' ELSE 'tomer' END] AS words FROM supplier)
SELECT sid, c_custkey FROM s, k WHERE contains(key, words[1]) AND contains(key, words[2])""")
def search_postings(t):
    """A search for each supplier, four digits and a piece of a word, over the keys of all customers."""
    key = F.concat_ws(" ", text.title_key(F.col("c_name")), F.lower("c_mktsegment"))
    titles = spread(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select("c_custkey", key.alias("key"))
    n = F.col("s_nationkey") % 4
    wanted = F.concat_ws(" ", F.substring(F.format_string("%05d", "s_suppkey"), 2, 4), F.when(n == 0, "build").when(n == 1, "ch").when(n == 2, "e").otherwise("tomer"))
    return search.search_all(search.postings(titles, "c_custkey", "key"), titles, "c_custkey", "key", t.supplier.select(F.col("s_suppkey").alias("sid"), wanted.alias("wanted")))


@query("""
SELECT o_orderkey, o_totalprice, o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS n, count(*) OVER () AS total FROM orders)
WHERE n > (total // 100) * 50 AND n <= (total // 100) * 50 + 50""")
def deep_page(t):
    """The page of fifty in the middle of all orders."""
    pages = paging.Pages(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), [F.desc("o_orderpriority"), F.col("o_totalprice"), F.col("o_orderkey")])
    return pages.page(pages.total // 100 + 1, 50)
