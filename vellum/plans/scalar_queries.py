"""Scalar functions over table columns: paths, labels, hashes, ranges, JSON, years."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import paths
from ..operators.documents import common_directory
from ._registry import query


@query(r"""
SELECT page_id, list_filter(regexp_split_to_array(url, '[\\/]+'), lambda x: x <> '') AS segments, lower(regexp_extract(regexp_extract(url, '([^\\/]*)$', 1), '^.+(\.[^.]*)$', 1)) AS extension FROM pages""")
def path_split(t):
    name = F.regexp_extract("url", r"([^\\/]*)$", 1)
    return t.pages.select("page_id", text.path_segments(F.col("url")).alias("segments"), text.split_extension(name)["extension"].alias("extension"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def slug(t):
    return t.documents.select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("""
SELECT doc_id, CASE lang WHEN 'fr' THEN 'French' WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE 'Unknown' END AS language,
  CASE WHEN lang IN ('fr', 'en', 'de', 'es') THEN lang ELSE 'und' END AS tag FROM documents""")
def language_tag_map(t):
    return t.documents.select("doc_id", labels.language_label(F.col("lang")).alias("language"), labels.language_tag(F.col("lang")).alias("tag"))


@query("SELECT p_partkey, CASE n WHEN 1 THEN 'Mono' WHEN 2 THEN 'Stereo' WHEN 6 THEN '5.1' WHEN 7 THEN '6.1' WHEN 8 THEN '7.1' ELSE n || ' channels' END AS label FROM (SELECT p_partkey, p_size % 10 AS n FROM part)")
def channel_label(t):
    return t.part.select("p_partkey", labels.channel_label(F.col("p_size") % 10).alias("label"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, printf('S%02dE%02d', l_linenumber, CAST(l_quantity AS INTEGER)) || CASE WHEN l_quantity % 2 = 0 THEN printf('-E%02d', CAST(l_quantity AS INTEGER) + 1) ELSE '' END AS label FROM lineitem")
def episode_label(t):
    q = F.col("l_quantity").cast("int")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", labels.episode_label(F.col("l_linenumber"), q, F.when(q % 2 == 0, q + 1)).alias("label"))


@query("""
SELECT event_id, CASE WHEN m <= 0 THEN NULL WHEN m < 60 THEN m || ' min left' WHEN m % 60 = 0 THEN m // 60 || ' h left' ELSE m // 60 || ' h ' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || ' left' END AS label
FROM (SELECT event_id, CAST(floor(greatest(0.0, 9000.0 - value * 60) / 60 + 0.5) AS INTEGER) AS m FROM events)""")
def remaining_label(t):
    return t.events.select("event_id", labels.remaining_label(F.col("value") * 60, F.lit(9000.0)).alias("label"))


@query("""
SELECT o_orderkey, CASE WHEN b >= 1000000000 THEN floor(b / 100000000 + 0.5) / 10 || ' GB' WHEN b >= 1000000 THEN floor(b / 100000 + 0.5) / 10 || ' MB' ELSE floor(b / 100 + 0.5) / 10 || ' kB' END AS size
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 3 * 5000 + 1) + 1000 AS b FROM orders)""")
def byte_format(t):
    b = F.floor("o_totalprice").cast("long") * (F.col("o_orderkey") % 3 * 5000 + 1) + 1000
    return t.orders.select("o_orderkey", text.human_bytes(b).alias("size"))


@query("SELECT o_orderkey, lower(to_hex(o_orderkey * 1048576)) || '-' || lower(to_hex(CAST(epoch_ms(o_orderdate) AS BIGINT))) AS etag FROM orders")
def etag_hex(t):
    millis = F.unix_millis(F.to_timestamp_ltz("o_orderdate"))
    return t.orders.select("o_orderkey", labels.etag(F.col("o_orderkey") * 1048576, millis).alias("etag"))


@query("SELECT page_id, left(sha256(url || '|' || page_id), 32) AS signature, sha1(url) AS cache_key FROM pages")
def sha_signature(t):
    return t.pages.select("page_id", labels.signature(F.col("url"), F.col("page_id").cast("string")).alias("signature"), F.sha1("url").alias("cache_key"))


_RANGE = "CASE o_orderkey % 9 WHEN 0 THEN 'bytes=0-' WHEN 1 THEN 'bytes=' || o_orderkey || '-' || (o_orderkey + 99) WHEN 2 THEN 'bytes=-500' WHEN 3 THEN 'bytes=-0' WHEN 4 THEN 'items=0-5' WHEN 5 THEN 'bytes=0-1,5-6' WHEN 6 THEN 'Bytes= 5 - 3' WHEN 7 THEN 'bytes=1e3-' END"


@query(f"""
SELECT o_orderkey, kind, CASE WHEN kind = 'partial' THEN CASE o_orderkey % 9 WHEN 0 THEN 0 WHEN 1 THEN o_orderkey ELSE greatest(0, 1000 - 500) END END AS start_byte,
  CASE WHEN kind = 'partial' THEN CASE o_orderkey % 9 WHEN 1 THEN least(o_orderkey + 99, 999) ELSE 999 END END AS end_byte
FROM (SELECT o_orderkey, {_RANGE} AS h, CASE o_orderkey % 9 WHEN 0 THEN 'partial' WHEN 1 THEN CASE WHEN o_orderkey >= 1000 THEN 'unsatisfiable' ELSE 'partial' END WHEN 2 THEN 'partial' WHEN 3 THEN 'unsatisfiable' WHEN 6 THEN 'unsatisfiable' ELSE 'full' END AS kind FROM orders)""")
def range_parse(t):
    k = F.col("o_orderkey")
    key = k.cast("string")
    header = F.when(k % 9 == 0, F.lit("bytes=0-")).when(k % 9 == 1, F.concat(F.lit("bytes="), key, F.lit("-"), (k + 99).cast("string"))).when(k % 9 == 2, F.lit("bytes=-500")).when(k % 9 == 3, F.lit("bytes=-0")).when(k % 9 == 4, F.lit("items=0-5"))
    header = header.when(k % 9 == 5, F.lit("bytes=0-1,5-6")).when(k % 9 == 6, F.lit("Bytes= 5 - 3")).when(k % 9 == 7, F.lit("bytes=1e3-"))
    return t.orders.select("o_orderkey", text.byte_range(header, F.lit(1000).cast("long")).alias("r")).select("o_orderkey", "r.kind", F.col("r.start").alias("start_byte"), F.col("r.end").alias("end_byte"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AS high FROM events")
def json_flatten(t):
    row = F.from_json("props", "k bigint")
    return t.events.select("event_id", row["k"].alias("k")).withColumn("high", F.col("k") >= 50)


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderdate < TIMESTAMP '1999-06-01' - INTERVAL 182 DAY THEN true ELSE false END AS expired, o_orderdate >= TIMESTAMP '1999-06-01' - INTERVAL 14 DAY AS recent FROM orders")
def year_extract(t):
    now = F.to_timestamp_ntz(F.lit("1999-06-01 00:00:00"))
    day = F.col("o_orderdate")
    year = F.left(day.cast("string"), F.lit(4)).cast("int")
    return t.orders.select("o_orderkey", year.alias("year"), (day < now - F.expr("INTERVAL 182 DAYS")).alias("expired"), (day >= now - F.expr("INTERVAL 14 DAYS")).alias("recent"))


@query("SELECT p_partkey, CAST(p_size * 40 AS INTEGER) AS width, CAST(p_size * 20 AS INTEGER) AS height, round(p_size * 40 / (p_size * 20), 3) AS ratio FROM part")
def dimensions(t):
    d = labels.dimensions(F.concat((F.col("p_size") * 40).cast("string"), F.lit("x"), (F.col("p_size") * 20).cast("string")))
    return t.part.select("p_partkey", d.alias("d")).select("p_partkey", "d.width", "d.height", F.round(F.col("d.width") / F.col("d.height"), 3).alias("ratio"))


@query(r"SELECT doc_id, CASE WHEN regexp_extract(text, '(?s)^(.{25,}?[.!?])(?:\s|$)', 1) <> '' THEN regexp_extract(text, '(?s)^(.{25,}?[.!?])(?:\s|$)', 1) ELSE text END AS sentence FROM documents")
def first_sentence(t):
    return t.documents.select("doc_id", labels.first_sentence(F.col("text")).alias("sentence"))


@query(r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]*)/', 1) AS lang FROM pages), l AS (SELECT DISTINCT host FROM p WHERE lang = 'en')
SELECT page_id, CASE WHEN lang = 'en' THEN '/english/' || regexp_extract(host, '//([^/]+)$', 1) || regexp_extract(url, '^https?://[^/]+/en(/.*)$', 1) WHEN host LIKE 'https%' THEN '/secure/' || regexp_extract(host, '//([^/]+)$', 1) || substring(url, length(host) + 1) END AS target FROM p""")
def longest_prefix_match(t):
    """Addresses under the longest root of a table that fits them: one for each host, and one for its English pages."""
    host = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    name = F.regexp_extract(host, "//([^/]+)$", 1)
    english = t.pages.filter(F.col("url").rlike("^https?://[^/]+/en/")).select(F.concat(host, F.lit("/en")).alias("source"), F.concat(F.lit("/english/"), name).alias("target"))
    secure = t.pages.filter("url like 'https%'").select(host.alias("source"), F.concat(F.lit("/secure/"), name).alias("target"))
    # a slash at the end is no part of a path
    return paths.remap(t.pages, english.unionByName(secure).distinct(), "url", "target").select("page_id", F.when(F.col("url").endswith("/"), F.concat("target", F.lit("/"))).otherwise(F.col("target")).alias("target"))


@query(r"""
SELECT page_id, CASE WHEN lower(url) LIKE 'https://blog.%' THEN '/mnt/blog' || substr(regexp_replace(url, '\\', '/', 'g'), length('https://blog.') + 0) WHEN lower(url) LIKE 'https://%' THEN '/mnt/web/' || substr(url, 9) END AS path FROM pages""", name="path_remap_prefix")
def path_remap_prefix(t):
    url = F.col("url")
    low = F.lower(url)
    blog = F.concat(F.lit("/mnt/blog"), F.call_function("substr", F.replace(url, F.lit("\\"), F.lit("/")), F.lit(13)))
    return t.pages.select("page_id", F.when(low.startswith("https://blog."), blog).when(low.startswith("https://"), F.concat(F.lit("/mnt/web/"), F.call_function("substr", url, F.lit(9)))).alias("path"))


@query(r"""
WITH s AS (SELECT regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang, string_split(lower(regexp_extract(url, '^(.*)/[^/]*$', 1)), '/') AS d FROM pages WHERE regexp_extract(url, '/(en|fr|de|es)/', 1) <> ''),
g AS (SELECT lang, list(d) AS a, min(len(d)) AS n FROM s GROUP BY 1), k AS (SELECT lang, a, i FROM g, range(0, 20) r(i) WHERE i <= n AND len(list_distinct(list_transform(a, lambda x: x[1:i]))) = 1)
SELECT lang, CASE WHEN max(i) = 0 THEN NULL ELSE array_to_string(arg_max(a, i)[1][1:max(i)], '/') END AS directory FROM k GROUP BY 1""", name="common_directory")
def common_directory_query(t):
    rows = t.pages.select(F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("lang"), F.lower("url").alias("path")).filter("lang <> ''")
    return common_directory(rows, ["lang"], "path", "directory")


@query("SELECT conv_id, CASE len(r) WHEN 1 THEN r[1] ELSE array_to_string(r[1:len(r) - 1], ', ') || ' and ' || r[len(r)] END AS roles FROM (SELECT conv_id, list_sort(list(DISTINCT role)) AS r FROM conversations GROUP BY 1)")
def joined_list(t):
    return t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("r")).select("conv_id", text.joined_list(F.col("r")).alias("roles"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN s // 3600 || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT event_id, CAST(floor(value * 60) AS BIGINT) AS s FROM events)")
def clock(t):
    return t.events.select("event_id", labels.clock(F.col("value") * 60).alias("clock"))


@query(r"""
WITH e AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+/.+([.][^./]*)$', 1)) AS extension FROM pages)
SELECT page_id, extension, CASE WHEN extension = '.html' THEN 'text/html' ELSE 'application/octet-stream' END AS media FROM e""")
def file_kinds(t):
    """The ending of each address and the media type it stands for."""
    extension = F.lower(F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"^https?://[^/]+/.+([.][^./]*)$", 1))
    return t.pages.select("page_id", extension.alias("extension"), labels.media_type(extension).alias("media"))
