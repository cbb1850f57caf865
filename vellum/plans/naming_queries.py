"""Names made from parts and orders, parsed back: the SQL side knows what they were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import glued, naming
from ..operators import playback
from ..operators.relational import spread
from ._registry import query


@query("SELECT p_partkey, p_name AS title, CAST(1950 + p_size AS INTEGER) AS year FROM part")
def noise_cut(t):
    """``blue.bolt.1961.1080p.BluRay.x264-GRP.mkv`` and bracketed forms."""
    year = (1950 + F.col("p_size")).cast("string")
    scene = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), year, F.lit(".1080p.BluRay.x264-GRP.mkv"))
    plain = F.concat("p_name", F.lit(" ("), year, F.lit(")/file.mkv"))
    name = F.when(F.col("p_partkey") % 2 == 0, scene).otherwise(plain)
    return spread(t.part.select("p_partkey", "p_name", "p_size"), "p_partkey").select("p_partkey", naming.parse_movie(name).alias("m")).select("p_partkey", "m.title", "m.year")


@query("SELECT o_orderkey, 'Customer ' || o_custkey AS show, CAST(1 + o_orderkey % 9 AS INTEGER) AS season, CAST(1 + o_orderkey % 50 AS INTEGER) AS first, CASE WHEN o_orderkey % 3 = 0 THEN CAST(2 + o_orderkey % 50 AS INTEGER) END AS last FROM orders")
def episode_marker(t):
    """Numbers of customers that look like years (1888 to 1900) are parsed as such; they belong to the name all the same."""
    k = F.col("o_orderkey")
    last = F.when(k % 3 == 0, F.format_string("-E%02d", 2 + k % 50)).otherwise("")
    name = F.concat(F.lit("Customer."), F.col("o_custkey").cast("string"), F.format_string(".S%02dE%02d", 1 + k % 9, 1 + k % 50), last, F.lit(".720p.WEB-DL.mkv"))
    return spread(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", naming.parse_episode(name, max_year=1900).alias("e")).select("o_orderkey", F.when(F.col("e.show").isNotNull(), F.concat_ws(" ", "e.show", F.col("e.show_year").cast("string"))).alias("show"), "e.season", "e.first", "e.last")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS language, doc_id % 3 = 0 AS forced, doc_id % 5 = 0 AS descriptive FROM documents")
def subtitle_suffix(t):
    k = F.col("doc_id")
    name = F.concat(F.lit("Film 2"), F.when(k % 3 == 0, ".forced").otherwise(""), F.when(k % 5 == 0, ".SDH").otherwise(""), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("."), F.upper("lang"))), F.lit(".srt"))
    return t.documents.select("doc_id", naming.parse_subtitle(name, F.lit("Film 2.mkv")).alias("s")).select("doc_id", "s.language", "s.forced", "s.descriptive")


_FILE = "SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN '.mp4' ELSE '.mkv' END AS e, CASE o_orderkey % 2 WHEN 0 THEN 'mov' ELSE 'matroska' END AS c, CASE o_orderkey % 5 WHEN 0 THEN 'h264' WHEN 1 THEN 'H264' WHEN 2 THEN 'hevc' WHEN 3 THEN 'prores' END AS v, CASE o_orderkey % 3 WHEN 0 THEN 'aac' ELSE 'dts' END AS a FROM orders"


@query(f"""
SELECT o_orderkey, CASE WHEN lower(v) = 'h264' AND a = 'aac' AND e = '.mp4' THEN 'direct' WHEN lower(v) = 'h264' THEN 'remux' WHEN v = 'hevc' THEN 'transcode' ELSE 'unsupported' END AS mode,
  CAST((coalesce(lower(v), '') <> 'h264')::INT + (a <> 'aac')::INT + (e <> '.mp4')::INT AS INTEGER) AS blockers FROM ({_FILE})""")
def playback_mode(t):
    k = F.col("o_orderkey")
    d = playback.decide(_chain(k % 2, (".mp4", ".mkv")), _chain(k % 2, ("mov", "matroska")), _chain(k % 5, ("h264", "H264", "hevc", "prores")), _chain(k % 3, ("aac", "dts", "dts")))
    return t.orders.select("o_orderkey", d.alias("d")).select("o_orderkey", "d.mode", F.size("d.blockers").alias("blockers"))


def _chain(key, values):
    out = F.when(key == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(key == i, v)
    return out


@query("""
SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 WHEN turn % 2 = 1 THEN 1 ELSE 2 END, turn) = 1""")
def audio_track_choice(t):
    return playback.choose_track(t.conversations.withColumn("flag", F.col("turn") % 2 == 1), "conv_id", "turn", "role", "flag", ["assistant"]).select("conv_id", "turn", "role")


_PEEL = {n: f"^(?is:(.{{3,}}?))(?i:({'|'.join(w for w in glued.FUNCTION_WORDS if len(w) >= n)}))$" for n in (2, 3)}
_GLUED = "(SELECT p_partkey, concat(upper(left(split_part(p_name, ' ', 1), 1)), substring(split_part(p_name, ' ', 1), 2), CASE p_size % 3 WHEN 0 THEN 'ofthe' WHEN 1 THEN 'andla' ELSE '' END, upper(left(split_part(p_name, ' ', 2), 1)), substring(split_part(p_name, ' ', 2), 2), CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'with' END, left(p_type, 1), lower(substring(p_type, 2)), 'Kk'[:p_partkey % 5 // 2], 1950 + p_size) AS name FROM part)"


def _rounds() -> str:
    """CTEs that peel a function word each: ``stem``, ``off`` and whether one was found."""
    out = ["r0 AS (SELECT *, piece AS stem, CAST([] AS VARCHAR[]) AS off, length(piece) >= 8 AS going FROM c)"]
    for n in range(1, 5):
        p = _PEEL[3 if n == 1 else 2]
        out.append(f"r{n} AS (SELECT p_partkey, name, nth, piece, CASE WHEN going AND regexp_matches(stem, '{p}') THEN regexp_extract(stem, '{p}', 1) ELSE stem END AS stem, CASE WHEN going AND regexp_matches(stem, '{p}') THEN list_prepend(regexp_extract(stem, '{p}', 2), off) ELSE off END AS off, going AND regexp_matches(stem, '{p}') AS going FROM r{n - 1})")
    return ",\n".join(out)


@query(f"""
WITH n AS {_GLUED},
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}}{{2,}})', '\\1 \\2', 'g'), '(\\p{{L}})([0-9])', '\\1 \\2', 'g'), '([0-9])(\\p{{Lu}})', '\\1 \\2', 'g') AS cut,
  length(name) >= 12 AND length(regexp_replace(substring(name, 2), '[^A-Z]', '', 'g')) >= 2 AS glued FROM n),
c AS (SELECT p_partkey, name, generate_subscripts(string_split(cut, ' '), 1) AS nth, unnest(string_split(cut, ' ')) AS piece FROM s WHERE glued),
{_rounds()},
w AS (SELECT *, CASE WHEN len(off) > 0 AND length(stem) <= 14 THEN list_prepend(stem, off) ELSE [piece] END AS words FROM r4),
j AS (SELECT p_partkey, string_agg(array_to_string(words, ' '), ' ' ORDER BY nth) AS told, bool_and(len(list_filter(words, lambda x: NOT (length(x) > 2 OR NOT regexp_matches(x, '^\\p{{L}}+$') OR x = upper(x) OR list_contains({glued.FUNCTION_WORDS}, lower(x))))) = 0) AS sane FROM w GROUP BY 1)
SELECT p_partkey, CASE WHEN sane THEN told ELSE name END AS told, CASE WHEN sane THEN regexp_extract(told, '^(.*) (\\d{{4}})$', 1) ELSE name END AS title, CASE WHEN sane THEN CAST(regexp_extract(told, '^(.*) (\\d{{4}})$', 2) AS INTEGER) END AS year FROM n LEFT JOIN j USING (p_partkey)""")
def glued_words(t):
    """Names in one piece: ``BlueoftheRingALarge1983`` is *Blue of the Ring A Large*, of 1983; some don't come apart into words and stay."""
    words = F.split("p_name", " ")
    cap = lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.length(x)))
    between = F.when(F.col("p_size") % 3 == 0, "ofthe").when(F.col("p_size") % 3 == 1, "andla").otherwise("")
    scrap = F.left(F.lit("Kk"), F.floor(F.col("p_partkey") % 5 / 2).cast("int"))
    name = F.concat(cap(words[0]), between, cap(words[1]), F.when(F.col("p_size") % 2 == 0, "A").otherwise("with"), cap(F.lower("p_type")), scrap, (1950 + F.col("p_size")).cast("string"))
    m = naming.title_and_year(name)
    return spread(t.part.select("p_partkey", "p_name", "p_size", "p_type"), "p_partkey").select("p_partkey", glued.segment(name).alias("told"), m.alias("m")).select("p_partkey", "told", "m.title", "m.year")
