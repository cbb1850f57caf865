"""Files by kind, probe documents, cues, captions, playlists and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, markup, naming
from ..operators import documents, playback
from ..operators.relational import spread
from ..sources import listing
from ._registry import query


# Paths of many parts: folders, words, separators, endings and sizes come from different columns.
_WHOLE = r"(^|[^\p{L}\p{N}])(" + "|".join(listing.SIDE_WORDS) + r")([^\p{L}\p{N}]|$)"
_PATHS = """
f AS (SELECT p_partkey, concat('/media/', p_brand, CASE p_partkey % 6 WHEN 1 THEN '/@eaDir' WHEN 2 THEN '/.cache' WHEN 3 THEN '/The Bonus' WHEN 4 THEN '/Season 1' WHEN 5 THEN chr(92) || 'Bonuses' ELSE '' END, '/',
   replace(p_name, ' ', CASE p_size % 3 WHEN 0 THEN '.' WHEN 1 THEN '-' ELSE ' ' END), CASE p_partkey % 7 WHEN 0 THEN '-sample' WHEN 1 THEN '.Trailer' WHEN 2 THEN 'sample' WHEN 3 THEN ' (extras)' ELSE '' END,
   CASE p_size % 7 WHEN 0 THEN '.mkv' WHEN 1 THEN '.MP4' WHEN 2 THEN '.srt' WHEN 3 THEN '.nfo' WHEN 4 THEN '.ts' WHEN 5 THEN '' ELSE '.avi' END) AS path, CAST(p_retailprice * 55000 AS BIGINT) AS size FROM part),
g AS (SELECT *, list_filter(regexp_split_to_array(path, '[' || chr(92) || chr(92) || '/]+'), lambda x: x <> '') AS parts FROM f),
h AS (SELECT *, parts[-1] AS name, lower(regexp_extract(parts[-1], '^.+([.][^.]*)$', 1)) AS ending FROM g)"""


def _paths(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    path = F.concat(
        F.lit("/media/"), "p_brand", pick(key % 6, "", "/@eaDir", "/.cache", "/The Bonus", "/Season 1", "\\Bonuses"), F.lit("/"), F.replace("p_name", F.lit(" "), pick(size % 3, ".", "-", " ")),
        pick(key % 7, "-sample", ".Trailer", "sample", " (extras)", "", "", ""), pick(size % 7, ".mkv", ".MP4", ".srt", ".nfo", ".ts", "", ".avi"),
    )
    return t.part.select("p_partkey", path.alias("path"), F.floor(F.col("p_retailprice") * 55000 + 0.5).cast("long").alias("size"))


_KINDS = f"""
r AS (SELECT *, CASE WHEN len(list_filter(parts[:-2], lambda x: lower(x) IN ('@eadir', '#recycle', '$recycle.bin', 'system volume information', 'lost+found') OR starts_with(x, '.') OR regexp_matches(x, '(?i){_WHOLE}'))) > 0 THEN 'folder'
  WHEN lower(name) IN ('desktop.ini', 'thumbs.db', '.ds_store') OR starts_with(name, '.') THEN 'name' WHEN ending IN ('.srt', '.ass', '.ssa', '.vtt', '.sub') THEN NULL
  WHEN ending NOT IN ('.mkv', '.mp4', '.avi', '.m4v', '.mov', '.wmv', '.ts', '.webm') THEN 'extension' WHEN regexp_matches(name, '(?i){_WHOLE}') THEN 'side content' WHEN size < 52428800 THEN 'too small' END AS skipped FROM h)"""


@query(f"WITH {_PATHS}, {_KINDS} SELECT p_partkey, CASE WHEN skipped IS NOT NULL THEN NULL WHEN ending = '.srt' THEN 'subtitle' ELSE 'video' END AS kind, skipped FROM r")
def file_classes(t):
    return listing.classify(_paths(t)).select("p_partkey", "kind", "skipped")


# Documents of which some are cut off, and some have a number where a text should be.
_JSON = """d AS (SELECT p_partkey, left(concat('{"minutes": ', p_size, ', "name": "', p_name, '", "of": [', p_partkey, ', ', p_partkey % 7, ']}'), CAST(length(p_name) + 25 + p_partkey % 60 AS INTEGER)) AS doc FROM part)"""


def _json(t):
    whole = F.concat(F.lit('{"minutes": '), F.col("p_size").cast("string"), F.lit(', "name": "'), "p_name", F.lit('", "of": ['), F.col("p_partkey").cast("string"), F.lit(", "), (F.col("p_partkey") % 7).cast("string"), F.lit("]}"))
    return t.part.select("p_partkey", F.left(whole, (F.length("p_name") + 25 + F.col("p_partkey") % 60).cast("int")).alias("doc"))


@query(f"WITH {_JSON} SELECT p_partkey, CAST(json_extract(doc, '$.minutes') AS INTEGER) AS minutes, json_extract_string(doc, '$.name') AS name, CAST(json_extract(doc, '$.of[1]') AS BIGINT) AS second FROM d WHERE json_valid(doc)")
def json_rows(t):
    return listing.json_documents(_json(t), "doc", "minutes int, name string, of array<long>").select("p_partkey", "minutes", "name", F.get("of", F.lit(1)).alias("second"))


@query(f"WITH {_JSON} SELECT p_partkey FROM d WHERE NOT json_valid(doc)")
def json_errors(t):
    return listing.broken_documents(_json(t), "doc", "minutes int, name string, of array<long>").select("p_partkey")


# Scripts made of many columns: each part has three dialogue lines, in any order, of which one may never be shown.
_LINES = r"""
l AS (SELECT p_partkey, k, p_size * 60 + (p_partkey * 7 + k * 11) % 40 AS s, p_size * 60 + (p_partkey * 7 + k * 11) % 40 + (p_partkey + k) % 4 AS e,
  concat('{\i', (p_size + k) % 2, '}', p_name, '{\b', p_size % 3 * 350, '\u', p_partkey % 2, '} ', p_type, ' & <', p_brand, '>{\i', p_partkey % 3, '\pos(1,2)}', CASE WHEN k = 1 THEN '\N' ELSE ', ' END, k, CASE WHEN p_size % 5 = 0 THEN '{\r}' ELSE '{\b0}' END, p_size, CASE WHEN p_partkey % 13 = k THEN '{\p1}m 0 0' ELSE '{\u0' END) AS x
  FROM part, (VALUES (0), (1), (2)) v(k))"""


def _scripts(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    num = lambda x: x.cast("string")
    at = lambda s: F.format_string("0:%02d:%02d.50", size, s)

    def line(k):
        s = (key * 7 + k * 11) % 40
        text = F.concat(
            F.lit("{\\i"), num((size + k) % 2), F.lit("}"), "p_name", F.lit("{\\b"), num(size % 3 * 350), F.lit("\\u"), num(key % 2), F.lit("} "), "p_type", F.lit(" & <"), "p_brand", F.lit(">{\\i"), num(key % 3), F.lit("\\pos(1,2)}"),
            F.lit("\\N" if k == 1 else ", "), F.lit(str(k)), F.when(size % 5 == 0, "{\\r}").otherwise("{\\b0}"), num(size), F.when(key % 13 == k, "{\\p1}m 0 0").otherwise("{\\u0"),
        )
        return F.concat(F.lit("Dialogue: 0,"), at(s), F.lit(","), at(s + (key + k) % 4), F.lit(","), text)

    return t.part.select("p_partkey", F.concat_ws("\n", F.lit("[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Text"), line(2), line(0), line(1)).alias("text"))


_NUMBERED = f"{_LINES}, c AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY s, e, x) - 1 AS INTEGER) AS nth FROM l WHERE e > s)"


@query(f"""WITH {_NUMBERED} SELECT p_partkey, nth, CAST(s + 0.5 AS DOUBLE) AS start, CAST(e + 0.5 AS DOUBLE) AS "end", x AS text FROM c""")
def subtitle_cues(t):
    return documents.cues(_scripts(t), "p_partkey", "text")


# Overrides worked off one by one by a recursive query: ops are texts (t) and commands (c), open tags are a list.
_STYLED = """
o AS (SELECT *, flatten(list_transform(regexp_extract_all(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?s)\\{[^}]*\\}|[^{]+|\\{.*'),
  lambda k: CASE WHEN regexp_matches(k, '^\\{[^}]*\\}$') THEN list_transform(list_filter(string_split(k[2:-2], chr(92)), lambda c: c <> ''), lambda c: 'c' || c) ELSE ['t' || k] END)) AS ops FROM c),
step AS (SELECT p_partkey, nth, ops, 1 AS n, '' AS out, CAST([] AS VARCHAR[]) AS open FROM o
  UNION ALL SELECT p_partkey, nth, ops, n + 1, out || CASE WHEN op[1] = 't' THEN op[2:] WHEN op[2] = 'r' THEN closed WHEN name = '' THEN '' WHEN turn AND place = 0 THEN '<' || name || '>' WHEN NOT turn AND place > 0 THEN above || '</' || name || '>' || again ELSE '' END,
    CASE WHEN op[1] = 't' THEN open WHEN op[2] = 'r' THEN [] WHEN name = '' THEN open WHEN turn AND place = 0 THEN list_append(open, name) WHEN NOT turn AND place > 0 THEN list_filter(open, lambda n: n <> name) ELSE open END
  FROM (SELECT *, coalesce(list_position(open, name), 0) AS place, array_to_string(list_transform(list_reverse(open), lambda n: '</' || n || '>'), '') AS closed, array_to_string(list_transform(list_reverse(open[coalesce(list_position(open, name), 0) + 1:]), lambda n: '</' || n || '>'), '') AS above,
      array_to_string(list_transform(open[coalesce(list_position(open, name), 0) + 1:], lambda n: '<' || n || '>'), '') AS again
    FROM (SELECT *, ops[n] AS op, CASE WHEN regexp_matches(ops[n], '^c[iu][01]$') THEN ops[n][2] WHEN regexp_matches(ops[n], '^cb[0-9]+$') THEN 'b' ELSE '' END AS name, NOT regexp_matches(ops[n], '^c[iub]0+$') AS turn FROM step WHERE n <= len(ops)))),
done AS (SELECT p_partkey, nth, trim(replace(out || array_to_string(list_transform(list_reverse(open), lambda n: '</' || n || '>'), ''), chr(92) || 'N', chr(10))) AS shown FROM step WHERE n = len(ops) + 1)"""


@query(f"""
WITH RECURSIVE {_NUMBERED}, {_STYLED}
SELECT p_partkey, 'WEBVTT' || chr(10) || chr(10) || string_agg(printf('%02d:%02d:%02d.500 --> %02d:%02d:%02d.500', s // 3600, s % 3600 // 60, s % 60, e // 3600, e % 3600 // 60, e % 60) || chr(10) || shown, chr(10) || chr(10) ORDER BY nth) || chr(10) AS document
FROM c JOIN done USING (p_partkey, nth) WHERE NOT regexp_matches(x, '\\\\p[1-9]') AND shown <> '' GROUP BY 1""")
def web_captions(t):
    return documents.web_captions(documents.cues(_scripts(t), "p_partkey", "text"), "p_partkey")


_FOREIGN = """concat('1', chr(10), '00:00:', 10 + p_size, ',500 --> 00:01:00,000', chr(10), '{\\an', p_size % 9, '}<FONT size="2" color=', CASE p_size % 3 WHEN 0 THEN '"' WHEN 1 THEN chr(39) ELSE '' END, split_part(p_name, ' ', 1), CASE p_size % 3 WHEN 0 THEN '"' WHEN 1 THEN chr(39) ELSE '' END, '>', p_type, '</font> <span class="x">{', p_brand, '}</span><i>', p_name, CASE WHEN p_partkey % 2 = 0 THEN '</i>' ELSE ' < 3' END, '<div', chr(10), '>')"""


@query(f"""
WITH f AS (SELECT p_partkey, {_FOREIGN} AS x FROM part),
l AS (SELECT p_partkey, generate_subscripts(string_split(x, chr(10)), 1) AS nth, unnest(string_split(x, chr(10))) AS line FROM f),
k AS (SELECT *, list_transform(regexp_extract_all(regexp_replace(line, '\\{{\\\\[^}}]*\\}}', '', 'g'), '</?[a-zA-Z]+[^>]*>|[^<]+|<'), lambda k: struct_pack(k := k, name := lower(regexp_extract(k, '^</?([a-zA-Z]+)[^>]*>$', 1)), colour := lower(regexp_extract(k, 'color\\s*=\\s*["'']?([a-zA-Z]+)', 1)), ends := starts_with(k, '</'))) AS tokens FROM l),
c AS (SELECT p_partkey, nth, CASE WHEN contains(line, '-->') THEN regexp_replace(line, '(\\d+:[0-5]\\d:[0-5]\\d),(\\d+)', '\\1.\\2', 'g') ELSE array_to_string(list_transform(tokens, lambda t: CASE WHEN t.name IN ('', 'i', 'b', 'u', 'ruby', 'rt', 'v', 'lang', 'c') THEN t.k WHEN t.name <> 'font' THEN '' WHEN t.ends THEN '</c>' WHEN t.colour IN ('white', 'lime', 'cyan', 'red', 'yellow', 'magenta', 'blue', 'black') THEN '<c.' || t.colour || '>' ELSE '<c>' END), '') END AS line FROM k)
SELECT p_partkey, 'WEBVTT' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY nth) AS document FROM c GROUP BY 1""")
def cleared_captions(t):
    """Numbered cues with fonts, foreign tags and override blocks as caption documents."""
    quote = F.when(F.col("p_size") % 3 == 0, '"').when(F.col("p_size") % 3 == 1, "'").otherwise("")
    x = F.concat(
        F.lit("1\n00:00:"), (10 + F.col("p_size")).cast("string"), F.lit(",500 --> 00:01:00,000\n{\\an"), (F.col("p_size") % 9).cast("string"), F.lit('}<FONT size="2" color='), quote, F.split("p_name", " ")[0], quote, F.lit(">"), "p_type",
        F.lit('</font> <span class="x">{'), "p_brand", F.lit("}</span><i>"), "p_name", F.when(F.col("p_partkey") % 2 == 0, "</i>").otherwise(" < 3"), F.lit("<div\n>"),
    )
    return spread(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey").select("p_partkey", markup.stamped_to_captions(x).alias("document"))


@query("""
SELECT l_orderkey, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || CAST(max(ceil(d)) AS BIGINT) || chr(10)
 || string_agg(printf('#EXTINF:%.3f,', d) || chr(10) || printf('seg-%05d.m4s', n), chr(10) ORDER BY n) || chr(10) || '#EXT-X-ENDLIST' || chr(10) AS playlist
FROM (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) / 4 AS d, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS INTEGER) AS n FROM lineitem) GROUP BY 1""")
def playlists(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")) - 1
    return documents.playlist(t.lineitem.select("l_orderkey", n.alias("index"), (F.col("l_quantity").cast("double") / 4).alias("duration")), "l_orderkey")


@query("SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock, printf('%02d:%02d:%02d.250', s // 3600, s % 3600 // 60, s % 60) AS cue FROM (SELECT o_orderkey, o_custkey * 7 % 20000 AS s FROM orders)")
def clocks(t):
    s = (F.col("o_custkey") * 7) % 20000
    return t.orders.select("o_orderkey", labels.clock(s.cast("double")).alias("clock"), labels.cue_time(s + 0.25).alias("cue"))


# Probe documents: cover art before or behind, streams in any number, languages and flags from several columns.
_PROBES = """
d AS (SELECT p_partkey, concat('{"format":{"format_name":"', CASE p_size % 2 WHEN 0 THEN 'matroska,webm' ELSE 'mov,mp4,m4a' END, '","duration":"', CASE WHEN p_size % 9 = 0 THEN 'N/A' ELSE p_size * 60 || '.5' END, '"},"streams":[',
  CASE WHEN p_partkey % 3 = 0 THEN '{"index":9,"codec_type":"video","codec_name":"mjpeg","width":1,"height":1},' ELSE '' END,
  CASE WHEN p_partkey % 11 = 5 THEN '' ELSE concat('{"index":0,"codec_type":"video","codec_name":"', lower(p_type), '","width":', p_size * 16, ',"height":', p_size * 9, CASE p_partkey % 4 WHEN 0 THEN ',"color_transfer":"SMPTE2084"' WHEN 1 THEN ',"color_transfer":"arib-std-b67"' ELSE '' END,
    ',"side_data_list":[', CASE p_size % 5 WHEN 0 THEN '{"side_data_type":"DOVI configuration record"}' WHEN 1 THEN '{"side_data_type":"Mastering"},{"side_data_type":"HDR Dynamic Metadata SMPTE2094-40"}' ELSE '' END, '],"disposition":{"attached_pic":', CASE WHEN p_partkey % 13 = 7 THEN 1 ELSE 0 END, '}},') END,
  coalesce((SELECT string_agg(concat('{"index":', k + 1, ',"codec_type":"', CASE WHEN (p_partkey + k) % 3 = 2 THEN 'subtitle' ELSE 'audio' END, '","codec_name":"c', (p_size + k) % 5, '","disposition":{"default":', CASE WHEN (p_size * 3 + k) % 4 = 3 THEN 1 ELSE 0 END, '}},'), '' ORDER BY k) FROM range(0, p_partkey % 6) r(k)), ''),
  '{"index":99,"codec_type":"data"}]}') AS doc FROM part),
s AS (SELECT p_partkey, doc, CAST(json_extract(doc, '$.streams') AS JSON[]) AS streams FROM d),
k AS (SELECT *, list_filter(streams, lambda x: json_extract_string(x, '$.codec_type') = 'video' AND json_extract_string(x, '$.codec_name') NOT IN ('mjpeg', 'png') AND coalesce(json_extract_string(x, '$.disposition.attached_pic'), '0') <> '1')[1] AS v,
  list_filter(streams, lambda x: json_extract_string(x, '$.codec_type') = 'audio') AS a, list_filter(streams, lambda x: json_extract_string(x, '$.codec_type') = 'subtitle') AS u FROM s),
z AS (SELECT *, lower(coalesce(CAST(json_extract(v, '$.side_data_list') AS VARCHAR), '')) AS side, json_extract_string(v, '$.color_transfer') AS transfer FROM k)"""


def _probes(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda x: x.cast("string")
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    video = F.concat(
        F.lit('{"index":0,"codec_type":"video","codec_name":"'), F.lower("p_type"), F.lit('","width":'), text(size * 16), F.lit(',"height":'), text(size * 9), pick(key % 4, ',"color_transfer":"SMPTE2084"', ',"color_transfer":"arib-std-b67"', "", ""), F.lit(',"side_data_list":['),
        pick(size % 5, '{"side_data_type":"DOVI configuration record"}', '{"side_data_type":"Mastering"},{"side_data_type":"HDR Dynamic Metadata SMPTE2094-40"}', "", "", ""), F.lit('],"disposition":{"attached_pic":'), F.when(key % 13 == 7, "1").otherwise("0"), F.lit("}},"),
    )
    track = lambda k: F.concat(F.lit('{"index":'), text(k + 1), F.lit(',"codec_type":"'), F.when((key + k) % 3 == 2, "subtitle").otherwise("audio"), F.lit('","codec_name":"c'), text((size + k) % 5), F.lit('","disposition":{"default":'), F.when((size * 3 + k) % 4 == 3, "1").otherwise("0"), F.lit("}},"))
    tracks = F.when(key % 6 > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), key % 6 - 1), track), "")).otherwise("")
    doc = F.concat(
        F.lit('{"format":{"format_name":"'), pick(size % 2, "matroska,webm", "mov,mp4,m4a"), F.lit('","duration":"'), F.when(size % 9 == 0, "N/A").otherwise(F.concat(text(size * 60), F.lit(".5"))), F.lit('"},"streams":['),
        F.when(key % 3 == 0, '{"index":9,"codec_type":"video","codec_name":"mjpeg","width":1,"height":1},').otherwise(""), F.when(key % 11 == 5, "").otherwise(video), tracks, F.lit('{"index":99,"codec_type":"data"}]}'),
    )
    return t.part.select("p_partkey", doc.alias("doc"))


@query(f"""
WITH {_PROBES}
SELECT p_partkey, string_split(json_extract_string(doc, '$.format.format_name'), ',')[1] AS container, TRY_CAST(json_extract_string(doc, '$.format.duration') AS DOUBLE) AS duration, json_extract_string(v, '$.codec_name') AS video_codec,
  CAST(json_extract(v, '$.width') AS INTEGER) AS width, CAST(json_extract(v, '$.height') AS INTEGER) AS height, CASE WHEN contains(side, 'dovi') THEN 'Dolby Vision' WHEN contains(side, '2094') THEN 'HDR10+' WHEN transfer = 'SMPTE2084' THEN 'HDR10' WHEN transfer = 'arib-std-b67' THEN 'HLG' END AS hdr,
  json_extract_string(coalesce(list_filter(a, lambda x: json_extract_string(x, '$.disposition.default') = '1')[1], a[1]), '$.codec_name') AS audio_codec, CAST(len(a) AS INTEGER) AS audio, CAST(len(u) AS INTEGER) AS subtitles FROM z""")
def probe_documents(t):
    flat = playback.flatten_probe(_probes(t), "doc")
    return flat.select("p_partkey", "container", "duration", "video_codec", "width", "height", "hdr", "audio_codec", F.size("audio").alias("audio"), F.size("subtitles").alias("subtitles"))


@query("""
WITH r AS (SELECT p_partkey, concat(CASE p_size % 4 WHEN 0 THEN p_name ELSE p_type END, CASE p_partkey % 3 WHEN 0 THEN ' (' WHEN 1 THEN '-' ELSE '' END, CASE p_partkey % 7 WHEN 0 THEN 'Forced' WHEN 1 THEN 'forcés' WHEN 2 THEN 'SDH' WHEN 3 THEN 'CC' WHEN 4 THEN 'enforced' ELSE '' END, CASE p_size % 2 WHEN 0 THEN ')' ELSE ' ' || p_brand END) AS title, p_size % 11 = 3 AS flag FROM part)
SELECT p_partkey, CASE WHEN flag OR regexp_matches(title, '(?i)(^|[^\\p{L}\\p{N}])forc(ed|é)s?([^\\p{L}\\p{N}]|$)') THEN 'forced' WHEN regexp_matches(title, '(?i)(^|[^\\p{L}\\p{N}])(sdh|cc)([^\\p{L}\\p{N}]|$)') THEN 'sdh' ELSE 'full' END AS kind FROM r""")
def subtitle_track_kinds(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    title = F.concat(F.when(size % 4 == 0, F.col("p_name")).otherwise(F.col("p_type")), pick(key % 3, " (", "-", ""), pick(key % 7, "Forced", "forcés", "SDH", "CC", "enforced", "", ""), F.when(size % 2 == 0, ")").otherwise(F.concat(F.lit(" "), "p_brand")))
    return t.part.select("p_partkey", playback.subtitle_kind(title, size % 11 == 3).alias("kind"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'N') OR l_linestatus = 'F'")
def offered_tracks(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_linestatus") == "F").alias("default"))
    return playback.offered_tracks(rows, "l_returnflag", "default", ["A", "N"]).select("l_orderkey", "l_linenumber")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 'unknown' WHEN p_size % 2 = 0 THEN 'movie' WHEN p_partkey % 5 = 3 THEN 'unknown' ELSE 'episode' END AS kind,
  CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_size % 2 = 0 THEN CASE WHEN p_partkey % 5 = 3 THEN p_name || ' ' || lower(p_type) ELSE p_name END WHEN p_partkey % 5 = 3 THEN NULL ELSE 'The ' || replace(p_brand, '#', ' ') END AS title,
  CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_size % 2 = 0 THEN CASE WHEN p_partkey % 5 = 3 THEN NULL ELSE CAST(1950 + p_size AS INTEGER) END WHEN p_partkey % 5 = 3 THEN NULL ELSE CAST(1 + p_partkey % 90 AS INTEGER) END AS number,
  CASE WHEN p_size % 2 = 0 OR p_partkey % 5 > 2 THEN NULL WHEN p_partkey % 5 = 2 THEN 0 ELSE CAST(1 + p_size % 9 AS INTEGER) END AS season FROM part""")
def path_kinds(t):
    """Films in folders and scene names, episodes in season and specials folders, and paths that are neither."""
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda x: x.cast("string")
    year, show = text(1950 + size), F.concat(F.lit("The "), F.replace("p_brand", F.lit("#"), F.lit(" ")))
    film = F.when(key % 5 < 2, F.concat(F.lit("/media/"), "p_name", F.lit(" ("), year, F.lit(")/film.mkv"))).when(key % 5 == 2, F.concat(F.lit("/media/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), year, F.lit(".1080p.WEB-DL.mkv"))).otherwise(F.concat(F.lit("/media/"), "p_name", F.lit("."), F.lower("p_type"), F.lit(".x265.mkv")))
    folder = F.when(key % 5 == 2, F.lit("Specials")).when(key % 5 == 1, F.concat(F.lit("Saison "), text(1 + size % 9))).otherwise(F.format_string("Season %02d", 1 + size % 9))
    marker = F.when(key % 5 == 0, F.format_string("S%02dE%02d", 1 + size % 9, 1 + key % 90)).when(key % 5 == 1, F.format_string("%dx%02d", 1 + size % 9, 1 + key % 90)).otherwise(F.format_string("Episode %d", 1 + key % 90))
    episode = F.when(key % 5 < 3, F.concat(F.lit("/media/"), show, F.lit("/"), folder, F.lit("/"), marker, F.lit(" - "), "p_name", F.lit(".mkv"))).otherwise(F.concat(F.lit("/media/"), show, F.lit("/"), "p_name", F.lit(".mkv")))
    kind = F.when(key % 5 == 4, "other").when(size % 2 == 0, "movie").otherwise("show")
    rows = t.part.select("p_partkey", naming.parse_path(F.when(size % 2 == 0, film).otherwise(episode), kind).alias("f"))
    return rows.select("p_partkey", "f.kind", F.coalesce("f.movie.title", "f.episode.show").alias("title"), F.coalesce("f.movie.year", "f.episode.first").alias("number"), "f.episode.season")


@query("SELECT '/cache/' || l_orderkey AS folder, list(DISTINCT CAST(l_linenumber AS INTEGER) ORDER BY CAST(l_linenumber AS INTEGER)) AS streams FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def ready_streams(t):
    ending = F.when(F.col("l_linestatus") == "F", ".vtt").otherwise(".tmp")
    path = F.concat(F.lit("/cache/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"), ending)
    return listing.ready_streams(t.lineitem.select(path.alias("path")))


@query("""
WITH r AS (SELECT p_brand AS id, p_partkey AS n, trim(concat(' /srv/', CASE p_size % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE replace(p_name, ' ', '/') END, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE '' END)) AS path, CASE p_partkey % 7 WHEN 0 THEN 'music' WHEN 1 THEN 'show' ELSE 'movie' END AS kind, p_partkey % 11 = 0 AS blank FROM part)
SELECT id, arg_min(path, n) AS path, arg_min(kind, n) AS kind FROM r WHERE NOT blank AND kind <> 'music' GROUP BY id, lower(path)""")
def configured_roots(t):
    """Settings of each brand, a JSON document made of its parts: their roots, the first of those that are alike."""
    key, size = F.col("p_partkey"), F.col("p_size")
    path = F.when(key % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" /srv/"), F.when(size % 3 == 0, F.upper("p_name")).when(size % 3 == 1, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("/"))), F.when(size % 4 == 0, " ").otherwise("")))
    kind = F.when(key % 7 == 0, "music").when(key % 7 == 1, "show").otherwise("movie")
    roots = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", path.alias("path"), kind.alias("kind")))), lambda r: F.struct(r["path"].alias("path"), r["kind"].alias("kind")))
    settings = t.part.groupBy(F.col("p_brand").alias("id")).agg(F.to_json(F.struct(roots.alias("roots"))).alias("doc"))
    return listing.configured_roots(settings, "doc", ["id"])
