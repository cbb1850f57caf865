"""Labels, parameters, gates, credits, rates, failures, versions and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import labels, naming, text
from ..operators import relational
from ..scratch import shared
from ..sources import listing
from ._registry import query


def _pick(n, *values):
    return F.get(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), n.cast("int"))


def _case(values: dict, column: str, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {default} END"


@query(f"""
WITH f AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '.MP4' WHEN 1 THEN '.m4v' WHEN 2 THEN '.mkv' WHEN 3 THEN '.ts' WHEN 4 THEN '.webm' WHEN 5 THEN '.Avi' WHEN 6 THEN '.mov' ELSE '.' || lower(p_type) END AS e,
  {list(labels.CODECS)}[CAST(p_partkey % 19 + 1 AS INTEGER)] AS v, coalesce({list(labels.CONTAINERS)}[CAST(p_size % 11 + 1 AS INTEGER)], lower(p_type)) AS c FROM part)
SELECT p_partkey, {_case(labels.MEDIA_TYPES, 'lower(e)', "'application/octet-stream'")} AS media, CASE WHEN v IS NULL THEN 'unknown' ELSE {_case(labels.CODECS, 'v', 'v')} END AS codec, {_case(labels.CONTAINERS, 'c', 'c')} AS container FROM f""")
def format_labels(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    ending = _pick(key % 9, ".MP4", ".m4v", ".mkv", ".ts", ".webm", ".Avi", ".mov", F.concat(F.lit("."), F.lower("p_type")), F.concat(F.lit("."), F.lower("p_type")))
    codec = _pick(key % 19, *labels.CODECS)
    container = F.coalesce(_pick(size % 11, *labels.CONTAINERS), F.lower("p_type"))
    return t.part.select("p_partkey", labels.media_type(ending).alias("media"), labels.format_label(codec, labels.CODECS).alias("codec"), labels.format_label(container, labels.CONTAINERS).alias("container"))


@query("""
WITH p AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN CAST(c_nationkey AS VARCHAR) WHEN 1 THEN '-' || c_nationkey WHEN 2 THEN ' ' || c_nationkey || '.5 ' WHEN 3 THEN c_nationkey || 'e2' WHEN 4 THEN 'NaN' WHEN 5 THEN 'Infinity' WHEN 6 THEN '  ' ELSE c_nationkey || 'x' END AS raw,
  CASE c_nationkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || c_mktsegment || ' ' END AS words FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(raw, '^[0-9]+$') AND CAST(raw AS BIGINT) > 0 THEN CAST(raw AS BIGINT) END AS id, CASE WHEN trim(raw) = '' THEN 0.0::DOUBLE WHEN isfinite(TRY_CAST(trim(raw) AS DOUBLE)) AND TRY_CAST(trim(raw) AS DOUBLE) >= 0 AND NOT starts_with(raw, '-') THEN TRY_CAST(trim(raw) AS DOUBLE)
  WHEN raw = '-0' THEN 0.0::DOUBLE END AS seconds, nullif(trim(words), '') AS words FROM p""")
def coerced_parameters(t):
    """Texts as ids (positive whole numbers), as seconds (finite, not negative) and as search words (trimmed, not blank)."""
    n = F.col("c_nationkey").cast("string")
    raw = _pick(F.col("c_custkey") % 8, n, F.concat(F.lit("-"), n), F.concat(F.lit(" "), n, F.lit(".5 ")), F.concat(n, F.lit("e2")), "NaN", "Infinity", "  ", F.concat(n, F.lit("x")))
    words = F.when(F.col("c_nationkey") % 3 == 0, "  ").when(F.col("c_nationkey") % 3 == 1, F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    seconds = text.finite_number(raw)
    return t.customer.select("c_custkey", text.positive_number(raw).alias("id"), F.when(seconds == 0, 0.0).otherwise(seconds).alias("seconds"), text.non_blank(words).alias("words"))


@query("""
WITH n AS (SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN '[' || p_brand || '].' WHEN 1 THEN '{x}__' ELSE '' END, CASE p_size % 6 WHEN 0 THEN '1080p.' || p_name WHEN 1 THEN p_name || '..BluRay' WHEN 2 THEN ' - ' || p_size || ' -' WHEN 3 THEN 'Final' WHEN 4 THEN '(x264)' ELSE '._' END) AS name FROM part),
b AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\[[^\\]]*\\]', ' ', 'g'), '\\{[^}]*\\}', ' ', 'g'), '[._]+', ' ', 'g'), '\\s+', ' ', 'g')) AS spaced FROM n),
c AS (SELECT *, regexp_replace(regexp_replace(spaced, '^[\\s._(\\[{–—-]+', ''), '[\\s._)\\]}–—-]+$', '') AS clean, regexp_replace(regexp_replace(name, '^[\\s._(\\[{–—-]+', ''), '[\\s._)\\]}–—-]+$', '') AS bare FROM b)
SELECT p_partkey, clean, clean = '' OR regexp_matches(clean, '(?i)^(1080p|x264|bluray)([^\\p{L}\\p{N}]|$)') AS noise, bare = '' OR regexp_matches(bare, '(?i)^(final|[0-9]+)$') AS meaningless FROM c""")
def noise_names(t):
    """Names without separators, blocks and edges; whether nothing but marks is left, and whether what is left is no title."""
    key, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(
        F.when(key % 5 == 0, F.concat(F.lit("["), "p_brand", F.lit("]."))).when(key % 5 == 1, "{x}__").otherwise(""),
        _pick(size % 6, F.concat(F.lit("1080p."), "p_name"), F.concat("p_name", F.lit("..BluRay")), F.concat(F.lit(" - "), size.cast("string"), F.lit(" -")), "Final", "(x264)", "._"),
    )
    clean = naming.trim_junk(naming.separators_to_spaces(naming.without_blocks(name)))
    return t.part.select("p_partkey", clean.alias("clean"), naming.is_only_noise(name).alias("noise"), naming.is_meaningless_title(name).alias("meaningless"))


@query("""
WITH l AS (SELECT l_orderkey, unnest([l_quantity / 2, -l_quantity]) AS t, l_returnflag = 'N' AS k, l_linenumber AS n FROM lineitem),
k AS (SELECT l_orderkey, list(t ORDER BY t) AS times FROM l WHERE k AND t >= 0 GROUP BY 1)
SELECT o_orderkey, CASE WHEN times IS NULL THEN [] ELSE list_prepend(0.0::DOUBLE, times[2:]) END AS times FROM orders LEFT JOIN k ON l_orderkey = o_orderkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def key_point_times(t):
    """Lines of times and flags, one document an order: the times flagged K that aren't negative, in order, the first set to 0."""
    flag = F.when(F.col("l_returnflag") == "N", "K__").otherwise("___")
    line = F.concat((F.col("l_quantity") / 2).cast("string"), F.lit(","), flag, F.lit("\n-"), F.col("l_quantity").cast("string"), F.lit(","), flag)
    documents = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(line), "\r\n").alias("lines"))
    return documents.select("o_orderkey", listing.point_times(F.col("lines")).alias("times"))


@query("""
SELECT c_custkey, s.s_suppkey, s.s_acctbal FROM customer LEFT JOIN supplier s ON s.s_nationkey = c_nationkey AND s.s_suppkey % 10 = c_custkey % 10 AND s.s_nationkey = 7""")
def join_with_parameter(t):
    """Customers with the suppliers of their nation and last digit, of nation 7 only: the nation is a parameter of the condition, so no customer is lost."""
    left = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 10).alias("digit"))
    right = t.supplier.select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 10).alias("digit"), F.col("s_nationkey").alias("wanted"), "s_suppkey", "s_acctbal")
    return relational.join_given(left, right, ["nation", "digit"], {"wanted": 7}).select("c_custkey", "s_suppkey", "s_acctbal")


@query("""
SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') THEN NULL ELSE o_orderpriority END AS fingerprint FROM orders""")
def exists_and_not_exists(t):
    """Fingerprints taken back where a line was returned and none is open."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus")
    told = relational.one_but_not_other(t.orders.select("o_orderkey", "o_orderpriority"), lines.filter("l_returnflag = 'R'"), lines.filter("l_linestatus = 'O'"), ["o_orderkey"], "stale")
    return told.select("o_orderkey", F.when(~F.col("stale"), F.col("o_orderpriority")).alias("fingerprint"))


@query("SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal < 0, s_suppkey % 3 = 0, s_name DESC) AS INTEGER) AS place FROM supplier")
def boolean_order(t):
    """Rows of a nation by two conditions, what doesn't hold first, then by name from behind."""
    order = [F.col("s_acctbal") < 0, F.col("s_suppkey") % 3 == 0, F.desc("s_name")]
    return relational.top_per_group(t.supplier, ["s_nationkey"], order, 1 << 30, rank="place").select("s_suppkey", "place")


@query("""
WITH w AS (SELECT p_partkey, p_name, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) AS shown, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linestatus = 'O' AND l_quantity > 45) AS available FROM part)
SELECT 'browse' AS list, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM w WHERE shown AND available UNION ALL SELECT 'search', count(*), CAST(sum(p_partkey) AS BIGINT) FROM w WHERE shown""")
def gate_and_search(t):
    """Browsing shows what has a file that is available; a search shows all that has a file."""
    lines = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), ((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)).alias("open"))
    works = t.part.select("p_partkey").join(lines.groupBy("p_partkey").agg(F.bool_or("open").alias("available")), "p_partkey", "left")
    shown, available = F.col("available").isNotNull(), F.coalesce("available", F.lit(False))
    count = lambda searching, name: relational.gated(works, shown, available, searching).agg(F.lit(name).alias("list"), F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))
    return count(False, "browse").unionByName(count(True, "search"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 20 AS person, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o FROM lineitem),
f AS (SELECT l_orderkey, person, min(o) AS o, arg_min(l_partkey, o) AS part FROM c WHERE l_returnflag <> 'A' GROUP BY 1, 2)
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY o) AS INTEGER) AS place, person, part FROM f""")
def credits_in_source_order(t):
    """People of each order's lines as they are listed, each once, and only of lines that were not returned early."""
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") % 20).alias("person"), F.col("l_partkey").alias("part"), "l_returnflag")
    lists = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    return relational.first_in_source(lists, ["l_orderkey"], "items", "person", ["person", "part"], lambda x: x["l_returnflag"] != "A")


@query("""
WITH s AS (SELECT l_suppkey, l_quantity AS v FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 3 > 0 AND l_quantity > 10 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) <= 5)
SELECT s_suppkey, round(coalesce((SELECT avg(v) FROM s WHERE l_suppkey = s_suppkey), (SELECT avg(v) FROM s)), 9) AS rate FROM supplier""")
def rates_with_fallback(t):
    """The mean of each supplier's last five returns; suppliers without any have the mean of all."""
    samples = t.lineitem.filter("l_returnflag = 'R' AND l_suppkey % 3 > 0 AND l_quantity > 10").withColumnRenamed("l_suppkey", "s_suppkey")
    rates = relational.recent_rates(samples, t.supplier.select("s_suppkey"), "s_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity", "rate")
    return rates.select("s_suppkey", F.round("rate", 9).alias("rate"))


@query("""
SELECT kind, genre, n FROM (SELECT o_orderstatus AS kind, c_mktsegment AS genre, count(*) FILTER (o_totalprice > 400000) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) WHERE n > 0""")
def facets_of_a_kind(t):
    """Of each kind of collection, the genres that it has anything of."""
    rows = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("kind"))
    return rows.join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("genre")), "c_custkey").groupBy("kind", "genre").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, c_name AS file, CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown cause' ELSE o_orderpriority END AS error FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def newest_failures(t):
    """The newest twenty orders that failed, with whose they are, and why, if that is known."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done")
    jobs = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", status.alias("status"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("error"))
    found = relational.newest_failures(jobs, t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("file")), "o_custkey", [F.desc("o_orderdate"), "o_orderkey"])
    return found.select("o_orderkey", "file", "error")


@query("SELECT o_orderkey, o_totalprice + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS price FROM orders WHERE o_orderstatus <> 'P'")
def latest_version(t):
    """Two versions of a table in one folder, the second made from the first; the last complete one is read."""
    path = f"{shared(t.spark)}/versions-{uuid.uuid4().hex}"
    listing.write_version(t.orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price")), path, ["o_orderstatus"])
    first = listing.read_latest(t.spark, path)
    listing.write_version(first.filter("o_orderstatus <> 'P'").withColumn("price", F.col("price") + F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)), path)
    return listing.read_latest(t.spark, path).select("o_orderkey", "price")


@query("""
SELECT CAST(row_number() OVER (ORDER BY title, year) - 1 AS INTEGER) AS nth, CASE WHEN year = 0 THEN title ELSE concat(title, ' (', year, ')') END AS line FROM (SELECT DISTINCT p_name AS title, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1950 + p_size END AS year FROM part)""")
def written_report(t):
    """A list of titles with their years, written as a text and read back line by line."""
    path = f"{shared(t.spark)}/report-{uuid.uuid4().hex}"
    rows = t.part.select(F.col("p_name").alias("title"), F.when(F.col("p_size") % 5 > 0, 1950 + F.col("p_size")).alias("year")).distinct().orderBy("title", F.coalesce("year", F.lit(0)))
    line = F.when(F.col("year").isNull(), F.col("title")).otherwise(F.concat("title", F.lit(" ("), F.col("year").cast("string"), F.lit(")")))
    listing.report(rows, path, line)
    return listing.read_report(t.spark, path).select("nth", "line")
