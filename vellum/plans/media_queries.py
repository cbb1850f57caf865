"""Titles of tracks, sizes of pictures, synopses and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, tracks, video
from ._registry import query

# Titles of tracks made of marks, names, kinds and encodings of several columns.
_RAW = """raw AS (SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN '| ' WHEN 1 THEN '*' ELSE '' END, CASE p_partkey % 9 WHEN 0 THEN 'VFF ' WHEN 1 THEN 'VO - ' WHEN 2 THEN 'Commentary: ' WHEN 3 THEN 'AD ' WHEN 4 THEN 'VFQ VO ' WHEN 5 THEN 'Дублированный ' ELSE '' END,
  CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN '' WHEN 2 THEN p_type || ' and ' || p_name || ' and more of ' || p_brand ELSE 'ab' END, CASE p_size % 7 WHEN 0 THEN ' (AAC 2.0)' WHEN 1 THEN ' : DTS-HD MA 5.1' WHEN 2 THEN ' English SDH' WHEN 3 THEN ' [French]' WHEN 4 THEN ' @ 448 kb/s, 6ch' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN ' |' WHEN 1 THEN ' forced subs' ELSE '' END) AS raw FROM part)"""


def _titles(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda n, *values: F.get(F.array(*(F.lit(v) if isinstance(v, str) else v for v in values)), n.cast("int"))
    raw = F.concat(
        pick(key % 4, "| ", "*", "", ""), pick(key % 9, "VFF ", "VO - ", "Commentary: ", "AD ", "VFQ VO ", "Дублированный ", "", "", ""), pick(size % 4, F.col("p_name"), "", F.concat("p_type", F.lit(" and "), "p_name", F.lit(" and more of "), "p_brand"), "ab"),
        pick(size % 7, " (AAC 2.0)", " : DTS-HD MA 5.1", " English SDH", " [French]", " @ 448 kb/s, 6ch", "", ""), pick(key % 5, " |", " forced subs", "", "", ""),
    )
    return t.part.select("p_partkey", raw.alias("raw"))


def _told() -> str:
    """What is left of a title without marks (the first hit of each) and without words that say nothing."""
    rest = "clean"
    for pattern, _, _ in tracks.MARKERS:
        rest = f"regexp_replace({rest}, '(?i:{pattern})', ' ')"
    for pattern in [*tracks.TECHNICAL, tracks.LANGUAGES, tracks.KINDS, tracks.FILLERS]:
        rest = f"regexp_replace({rest}, '(?i:{pattern})', ' ', 'g')"
    return rest


_CLEAN = r"""c AS (SELECT *, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(raw, '[|*_~]+', ' ', 'g'), '[‐-―]', '-', 'g'), '\s+', ' ', 'g')), '^[\s:,.()\[\]-]+|[\s:,.()\[\]-]+$', '', 'g')) AS clean FROM raw)"""
_MARKS = ", ".join("CASE WHEN " + " AND ".join([f"regexp_matches(clean, '(?i:{p})')", *(f"NOT regexp_matches(clean, '(?i:{q})')" for q, _, g in tracks.MARKERS[:i] if g == f)]) + f" THEN '{label}' END" for i, (p, label, f) in enumerate(tracks.MARKERS))


@query(rf"""
WITH {_RAW}, {_CLEAN}, l AS (SELECT *, length(regexp_replace(clean, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(clean, '[^\p{{Latin}}]', '', 'g')) AS latin, length(regexp_replace({_told()}, '[^\p{{L}}]', '', 'g')) AS told FROM c)
SELECT p_partkey, CASE WHEN letters > 0 AND latin >= letters * 0.6 AND told >= 3 THEN CASE WHEN length(clean) > 42 THEN rtrim(substring(clean, 1, 41)) || '…' ELSE clean END END AS title, array_to_string(list_filter([{_MARKS}], lambda x: x IS NOT NULL), ',') AS marks FROM l""")
def track_titles(t):
    return _titles(t).select("p_partkey", tracks.informative_title(F.col("raw")).alias("title"), F.array_join(tracks.title_markers(F.col("raw")), ",").alias("marks"))


@query("""
SELECT p_partkey, CASE WHEN h > 1080 THEN 12000000 WHEN h > 720 THEN 6000000 WHEN h > 576 THEN 3000000 ELSE 1500000 END AS rate, least(h, 1080) AS out_height,
  CASE WHEN h > 1080 * 1.05 THEN CAST(floor(w * 1080.0 / h + 0.5) AS INTEGER) + CAST(floor(w * 1080.0 / h + 0.5) AS INTEGER) % 2 ELSE w + w % 2 END AS width, CASE WHEN h > 1080 * 1.05 THEN 1080 ELSE h + h % 2 END AS height
FROM (SELECT p_partkey, CAST(p_size * 79 AS INTEGER) AS w, CAST(p_size * 45 AS INTEGER) AS h FROM part)""")
def output_geometry(t):
    w, h = (F.col("p_size") * 79).cast("int"), (F.col("p_size") * 45).cast("int")
    size = video.output_size(w, h, F.lit(video.TARGET_HEIGHT))
    return t.part.select("p_partkey", video.bit_rate(h).alias("rate"), video.output_height(h).alias("out_height"), size["width"].alias("width"), size["height"].alias("height"))


@query("""
WITH d AS (SELECT p_partkey, left(concat('{"streams":[{"side_data_list":[', CASE p_size % 3 WHEN 0 THEN '{"side_data_type":"other","dv_profile":3},' ELSE '' END, '{"side_data_type":"', CASE p_partkey % 4 WHEN 3 THEN 'none' ELSE 'DOVI configuration record' END, '","dv_profile":', p_size % 10, '}]},{"side_data_list":[{"side_data_type":"DOVI configuration record","dv_profile":5}]}]}'), 400 - CASE WHEN p_partkey % 9 = 1 THEN 360 ELSE 0 END) AS doc FROM part),
p AS (SELECT p_partkey, CASE WHEN json_valid(doc) THEN coalesce(CAST(json_extract(list_filter(CAST(json_extract(doc, '$.streams[0].side_data_list') AS JSON[]), lambda x: json_extract_string(x, '$.side_data_type') = 'DOVI configuration record')[1], '$.dv_profile') AS INTEGER), 0) ELSE 0 END AS profile FROM d)
SELECT p_partkey, profile, profile IN (0, 4, 7, 8) AS base FROM p""")
def dolby_vision(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    doc = F.concat(
        F.lit('{"streams":[{"side_data_list":['), F.when(size % 3 == 0, '{"side_data_type":"other","dv_profile":3},').otherwise(""), F.lit('{"side_data_type":"'), F.when(key % 4 == 3, "none").otherwise("DOVI configuration record"), F.lit('","dv_profile":'), (size % 10).cast("string"),
        F.lit('}]},{"side_data_list":[{"side_data_type":"DOVI configuration record","dv_profile":5}]}]}'),
    )
    cut = F.left(doc, F.when(key % 9 == 1, 40).otherwise(400))
    return t.part.select("p_partkey", video.dolby_layer(cut)["profile"].alias("profile")).select("p_partkey", "profile", video.has_base_layer(F.col("profile")).alias("base"))


@query("SELECT event_id, CASE WHEN value > 0 THEN round(60 / (value / 100.0) - 60, 6) END AS seconds_left FROM events")
def time_left(t):
    return t.events.select("event_id", F.round(video.time_left(F.lit(60.0), F.col("value") / 100.0), 6).alias("seconds_left"))


@query("""
SELECT o_orderkey, CAST(CASE WHEN l[1] <> 1 THEN 0 WHEN len(l) < 2 OR l[2] <> 1 THEN 1 WHEN len(l) < 3 OR l[3] <> 1 THEN 2 ELSE 3 END AS INTEGER) AS n
FROM (SELECT l_orderkey AS o_orderkey, list(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END ORDER BY l_linenumber, l_partkey) AS l FROM lineitem GROUP BY 1)""")
def leading_run(t):
    """Lines that agree in number and part stay in the order of the files, as in a stable sort; the SQL leaves it open."""
    one = F.when(F.col("l_returnflag") == "N", 1).otherwise(2)
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", one.alias("x"), *place)
    lists = rows.groupBy("o_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "file", "row", "x"))), lambda r: r["x"]).alias("l"))
    return lists.select("o_orderkey", video.leading_run(F.col("l"), F.lit(1), 3).alias("n"))


@query("SELECT l_orderkey AS work, count(*) FILTER (l_linenumber IN (2, 4)) AS texts, count(*) FILTER (l_linenumber IN (2, 4)) = 0 AS image_only FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1")
def subtitle_kinds(t):
    texts = F.count_if(F.col("l_linenumber").isin(2, 4))
    return t.lineitem.filter("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("work")).agg(texts.alias("texts"), (texts == 0).alias("image_only"))


@query("SELECT p_partkey, p_size % 7 = 0 AS broken FROM part")
def replacement_characters(t):
    name = F.when(F.col("p_size") % 7 == 0, F.concat("p_name", F.lit("\ufffd"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", name.contains("\ufffd").alias("broken"))


@query("SELECT o_orderkey, o_orderdate > DATE '1998-08-01' - 14 AS new_home, o_orderdate > DATE '1998-08-01' - 30 AS new_tile FROM orders")
def recently_added(t):
    age = F.datediff(F.lit("1998-08-01").cast("date"), F.col("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", (age < 14).alias("new_home"), (age < 30).alias("new_tile"))


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS known, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'title' END AS sort, CASE WHEN c_nationkey > 0 AND c_acctbal >= 0 THEN CAST(c_nationkey AS BIGINT) END AS page FROM customer")
def parameters(t):
    page = F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("string")).otherwise(F.concat(F.lit("-"), F.col("c_nationkey").cast("string")))
    sort = text.one_of(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], "title")
    return t.customer.select("c_custkey", F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("known"), sort.alias("sort"), text.positive_number(page).alias("page"))


@query("SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#22', 'Brand#33')")
def not_in_json(t):
    """Rows whose brand is in none of the lists of a JSON value."""
    listed = t.spark.range(1).select(F.explode(F.from_json(F.lit('["Brand#11", "Brand#22", "Brand#33"]'), "array<string>")).alias("p_brand"))
    return t.part.join(F.broadcast(listed), "p_brand", "left_anti").select("p_partkey")


@query("""
WITH x AS (SELECT p_partkey, k, CASE (p_size + k) % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' ELSE 'de' END AS language, CASE WHEN (p_partkey + k * 2) % 5 < 2 THEN '  ' ELSE concat(' ', p_name, ' ', k) END AS overview FROM part, range(0, 4) r(k))
SELECT p_partkey, trim(arg_min(overview, struct_pack(a := CASE language WHEN 'fr' THEN 0 ELSE 1 END, k := k)) FILTER (trim(overview) <> '' AND language <> 'de')) AS overview FROM x GROUP BY 1""")
def fallback_overview(t):
    """Four translations each, some blank, in languages that shift from part to part: the first French one that is not blank, else the first English one."""
    key, size = F.col("p_partkey"), F.col("p_size")
    entry = lambda k: F.struct(
        F.get(F.array(F.lit("fr"), F.lit("en"), F.lit("de")), ((size + k) % 3).cast("int")).alias("language"), F.when((key + k * 2) % 5 < 2, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(f" {k}"))).alias("overview"))
    return t.part.select("p_partkey", text.first_translation(F.array(*map(entry, range(4))), ["fr", "en"]).alias("overview"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'show' END AS kind, CASE WHEN p_size % 3 < 2 THEN p_partkey END AS id FROM part")
def review_keys(t):
    kind = F.when(F.col("p_size") % 3 == 0, "movie-").when(F.col("p_size") % 3 == 1, "show-").otherwise("other-")
    return t.part.select("p_partkey", text.review_key(F.concat(kind, F.col("p_partkey").cast("string"))).alias("k")).select("p_partkey", "k.kind", "k.id")


@query("SELECT p_partkey, '/images/poster/w342/' || p_partkey || '.jpg 342w, /images/poster/w780/' || p_partkey || '.jpg 780w' AS srcset FROM part")
def image_sets(t):
    path = F.concat(F.when(F.col("p_size") % 2 == 0, "/").otherwise(""), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    return t.part.select("p_partkey", text.image_set("poster", path, {"w342": 342, "w780": 780}).alias("srcset"))


@query(r"""
WITH d AS (SELECT p_partkey, concat('/shows', CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '/x' ELSE '/' || p_brand END, CASE p_size % 5 WHEN 0 THEN '/Season ' || p_size WHEN 1 THEN '/SAISON_0' || p_size WHEN 2 THEN chr(92) || 'season.' || p_size WHEN 3 THEN '/Seasonal ' || p_size ELSE '/extras' END) AS directory FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(directory, '(?i)[/\\](season|saison)[ ._-]*\d+$') AND length(regexp_replace(directory, '[/\\][^/\\]*$', '')) > length('/shows') THEN regexp_replace(directory, '[/\\][^/\\]*$', '') ELSE directory END AS directory FROM d""")
def show_directories(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    above = F.when(key % 6 == 0, "").when(key % 6 == 1, "/x").otherwise(F.concat(F.lit("/"), "p_brand"))
    n = size.cast("string")
    last = F.when(size % 5 == 0, F.concat(F.lit("/Season "), n)).when(size % 5 == 1, F.concat(F.lit("/SAISON_0"), n)).when(size % 5 == 2, F.concat(F.lit("\\season."), n)).when(size % 5 == 3, F.concat(F.lit("/Seasonal "), n)).otherwise("/extras")
    return t.part.select("p_partkey", text.show_directory(F.concat(F.lit("/shows"), above, last), F.lit("/shows"), r"(?i)^(?:season|saison)[ ._-]*\d+$").alias("directory"))


@query(f"""
WITH s AS (SELECT *, {text.SITES}[CAST(p_partkey % {len(text.SITES)} + 1 AS INTEGER)] AS site FROM part)
SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'My ' || p_name || ' ' || p_size WHEN p_size % 4 = 0 AND contains(site, ' ') THEN split_part(site, ' ', 1) || ' ' || p_name ELSE p_name END AS name FROM s""")
def release_sites(t):
    """Every site with every kind of mark, in front with a number, in front with an address, or behind; some names only look like it."""
    key, size = F.col("p_partkey"), F.col("p_size")
    site = F.get(F.array(*map(F.lit, text.SITES)), (key % len(text.SITES)).cast("int"))
    domain = F.get(F.array(*map(F.lit, text.SITE_DOMAINS)), (size % len(text.SITE_DOMAINS)).cast("int"))
    name = (
        F.when(size % 4 == 0, F.concat(site, F.lit(" "), domain, F.lit("-"), (key + 10).cast("string"), F.lit("- "), "p_name")).when(size % 4 == 1, F.concat(F.lit("www2."), F.upper(site), F.lit("."), domain, F.lit(" - "), "p_name"))
        .when(size % 4 == 2, F.concat("p_name", F.lit(" - "), site)).otherwise(F.concat(F.lit("My "), "p_name", F.lit(" "), size.cast("string")))
    )
    return t.part.select("p_partkey", text.strip_release_sites(name).alias("name"))


@query(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS clean FROM documents),
s AS (SELECT doc_id, CASE WHEN regexp_extract(clean || ' ', '^(.{24,}?[.!?…]) ', 1) <> '' THEN regexp_extract(clean || ' ', '^(.{24,}?[.!?…]) ', 1) ELSE clean END AS sentence FROM c),
w AS (SELECT *, substring(sentence, 1, 150) AS w FROM s),
p AS (SELECT *, coalesce(list_max(list_filter(range(1, length(w) + 1), lambda i: contains(',;:—–', w[i]))) - 1, -1) AS soft, list_max(list_filter(range(1, length(w) + 1), lambda i: w[i] = ' ')) - 1 AS blank FROM w)
SELECT doc_id, CASE WHEN sentence = '' THEN NULL WHEN length(sentence) <= 150 THEN sentence ELSE regexp_replace(substring(w, 1, CAST(CASE WHEN soft >= 83 THEN soft ELSE coalesce(blank, length(w)) END AS BIGINT)), '[ \t\n\x0B\f\r.,;:!?—–]+$', '') || '…' END AS synopsis FROM p""")
def short_synopses(t):
    """Whole texts in, a sentence out."""
    return t.documents.select("doc_id", text.short_synopsis(F.col("text")).alias("synopsis"))


@query("SELECT p_partkey FROM part ORDER BY md5('7-' || p_partkey), p_partkey LIMIT 5")
def random_five(t):
    """Five rows in the order of a seeded digest: a sample that comes out the same each time."""
    return t.part.orderBy(F.md5(F.concat(F.lit("7-"), F.col("p_partkey").cast("string")).cast("binary")), "p_partkey").limit(5).select("p_partkey")
