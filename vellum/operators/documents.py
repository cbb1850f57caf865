"""Documents and paths: common directories, subtitle cues, playlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import cue_time, parse_clock
from ..functions.markup import overrides_to_tags
from ..functions.text import once
from .relational import spread


def common_directory(rows: DataFrame, keys: list[str], path: str, name: str) -> DataFrame:
    """The longest directory that all paths of a group share, by whole segments; null if none.

    What all share, the least and the greatest path share; so a group needs two rows, not all.
    """
    parts = F.split(F.regexp_extract(path, r"^(.*)[\\/][^\\/]*$", 1), r"[\\/]")
    ends = rows.select(*keys, parts.alias("__p")).groupBy(*keys).agg(F.min("__p").alias("__a"), F.max("__p").alias("__b"))
    a, b = F.col("__a"), F.col("__b")
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    n = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)).cast("int") - 1, F.least(F.size(a), F.size(b)))
    return ends.select(*keys, F.when(n > 0, F.array_join(F.slice(a, F.lit(1), n), "/")).alias(name))


def cues(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Cues of subtitle scripts with an events section: id, ``nth``, ``start``, ``end``, ``text``.

    The format line names the fields in any order; the last field keeps its commas. Cues that
    don't end after they start are dropped; the rest are numbered by start and end.
    """
    lines = lambda text: F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x))
    section = lambda acc, x: F.struct(
        F.when(x.rlike(r"^\[.*\]$"), F.lower(x) == "[events]").otherwise(acc["on"]).alias("on"),
        F.when(acc["on"] & x.rlike("(?i)^format:"), F.transform(F.split(F.regexp_replace(x, "(?i)^format:", ""), ","), lambda f: F.lower(F.trim(f)))).otherwise(acc["fields"]).alias("fields"),
        F.when(acc["on"] & x.rlike("(?i)^dialogue:"), F.array_append(acc["rows"], F.struct(acc["fields"].alias("f"), F.trim(F.regexp_replace(x, "(?i)^dialogue:", "")).alias("v")))).otherwise(acc["rows"]).alias("rows"),
    )
    start = F.expr("named_struct('on', false, 'fields', cast(array() as array<string>), 'rows', cast(array() as array<struct<f:array<string>,v:string>>))")

    def made(r):
        # as many parts as there are fields: the last one keeps its commas
        field = lambda v, name: F.get(v, F.array_position(r["f"], name).cast("int") - 1)
        cue = lambda v: F.struct(parse_clock(field(v, "start")).alias("start"), parse_clock(field(v, "end")).alias("end"), field(v, "text").alias("text"))
        return once(lambda v: F.when(F.size(v) >= F.size(r["f"]), cue(v)), F.split(r["v"], ",", F.size(r["f"])))

    cue_list = lambda acc: F.filter(F.transform(acc["rows"], made), lambda c: c["end"] > c["start"])
    found = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").select("id", F.aggregate(lines("text"), start, section, cue_list).alias("c"))
    ordered = found.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("c"))).alias("c"))
    return ordered.select(F.col("id").alias(id_col), F.posexplode("c").alias("nth", "c")).select(id_col, "nth", "c.start", "c.end", "c.text")


def web_captions(rows: DataFrame, id_col: str) -> DataFrame:
    """Cues as one caption document each: ``document``. Style overrides become tags; cues with nothing to show are left out."""
    one = lambda x: F.concat(cue_time(F.col("start")), F.lit(" --> "), cue_time(F.col("end")), F.lit("\n"), x)
    shown = once(lambda x: F.when(x.isNotNull(), F.struct(F.col("nth").alias("nth"), one(x).alias("x"))), overrides_to_tags(F.col("text")))
    # nulls are not listed, so overrides are worked out once and not for a filter too
    listed = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(shown)).alias("c")).filter("size(c) > 0")
    return listed.select(id_col, F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("c", lambda c: c["x"]), "\n\n"), F.lit("\n")).alias("document"))


def playlist(rows: DataFrame, key: str) -> DataFrame:
    """Segments (``index``, ``duration``) as a playlist text each: ``playlist``."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "duration"))).alias("s"))
    longest = F.ceil(F.array_max(F.transform("s", lambda x: x["duration"]))).cast("string")
    lines = F.transform("s", lambda x: F.concat(F.format_string("#EXTINF:%.3f,\n", x["duration"]), F.format_string("seg-%05d.m4s", x["index"])))
    return listed.select(key, F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:7\n#EXT-X-TARGETDURATION:"), longest, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n#EXT-X-ENDLIST\n")).alias("playlist"))
