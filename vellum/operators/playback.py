"""How a file can be played, and which of its tracks are offered and chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import joined_list

# What plays as it is, and which codecs can be converted.
DIRECT_EXTENSIONS, DIRECT_CONTAINERS, DIRECT_VIDEO, DIRECT_AUDIO = [".mp4", ".m4v"], ["mov", "mp4"], ["h264"], ["aac"]
CONVERTIBLE = ["hevc", "h265", "mpeg4", "av1", "vp9", "vp8", "mpeg2video", "vc1", "msmpeg4v3", "wmv3"]


def _is(x: Column, values: list[str]) -> Column:
    return F.coalesce(F.lower(x).isin(values), F.lit(False))


def decide(extension: Column, container: Column, video: Column, audio: Column, converter: Column | bool = True) -> Column:
    """Struct of mode (direct, remux, transcode, unsupported) and of blockers, what stands against playing as it is."""
    name = lambda x: F.coalesce(x, F.lit("unknown"))
    blockers = F.array_compact(F.array(
        F.when(~_is(video, DIRECT_VIDEO), F.concat(F.lit("video is "), name(video))), F.when(~_is(audio, DIRECT_AUDIO), F.concat(F.lit("audio is "), name(audio))),
        F.when(~(_is(extension, DIRECT_EXTENSIONS) & _is(container, DIRECT_CONTAINERS)), F.concat(F.lit("container is "), name(container))),
    ))
    able = converter if isinstance(converter, Column) else F.lit(converter)
    mode = (
        F.when(container.isNull() & video.isNull(), "unsupported").when(F.size(blockers) == 0, "direct").when(_is(video, DIRECT_VIDEO) & able, "remux").when(_is(video, CONVERTIBLE) & able, "transcode").otherwise("unsupported")
    )
    return F.struct(mode.alias("mode"), blockers.alias("blockers"), joined_list(blockers).alias("reason"))


def choose_track(tracks: DataFrame, key: str, index: str, language: str, default: str, wanted: list[str]) -> DataFrame:
    """One track of each file: the first wanted language there is, else the default one, else the first."""
    rank = F.when(F.lit(False), 0)
    for i, code in enumerate(wanted):
        rank = rank.when(F.col(language) == code, i)
    rank = rank.when(F.col(default), len(wanted)).otherwise(len(wanted) + 1)
    w = Window.partitionBy(key).orderBy(rank, index)
    return tracks.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def offered_tracks(tracks: DataFrame, language: str, default: str, languages: list[str]) -> DataFrame:
    """Tracks in one of the languages, and default ones whatever theirs."""
    return tracks.filter(F.col(language).isin(languages) | F.coalesce(F.col(default), F.lit(False)))


def subtitle_kind(title: Column, forced: Column) -> Column:
    """``forced``, ``sdh`` or ``full``."""
    return F.when(F.coalesce(forced, F.lit(False)) | F.coalesce(title.rlike(r"(?iu)(?<![\p{L}\p{N}])forc(?:ed|é)s?(?![\p{L}\p{N}])"), F.lit(False)), "forced").when(F.coalesce(title.rlike(r"(?iu)(?<![\p{L}\p{N}])(?:sdh|cc)(?![\p{L}\p{N}])"), F.lit(False)), "sdh").otherwise("full")


def flatten_probe(rows: DataFrame, column: str) -> DataFrame:
    """A probe document flattened: container, duration, the first real video stream (no cover art), the default
    audio codec, and the audio and subtitle streams as arrays. Tag names match in any case."""
    schema = "format struct<format_name:string,duration:string,bit_rate:string>, streams array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,channels:int,color_transfer:string,side_data_list:array<struct<side_data_type:string>>,tags:map<string,string>,disposition:map<string,int>>>"
    doc = F.from_json(column, schema)
    of = lambda kind: F.filter("__d.streams", lambda s: s["codec_type"] == kind)
    flag = lambda s, name: F.coalesce(F.try_element_at(s["disposition"], F.lit(name)) == 1, F.lit(False))
    tag = lambda s, name: F.get(F.map_values(F.map_filter(s["tags"], lambda k, _: F.lower(k) == name)), F.lit(0))
    track = lambda s: F.struct(s["index"].alias("index"), s["codec_name"].alias("codec"), s["channels"].alias("channels"), tag(s, "language").alias("language"), tag(s, "title").alias("title"), flag(s, "default").alias("default"), flag(s, "forced").alias("forced"))
    video = F.get(F.filter(of("video"), lambda s: ~flag(s, "attached_pic") & ~s["codec_name"].isin("mjpeg", "png")), F.lit(0))
    parsed = rows.withColumn("__d", doc).withColumns({"__v": video, "audio": F.transform(of("audio"), track), "subtitles": F.transform(of("subtitle"), track)})
    side = lambda word: F.exists("__v.side_data_list", lambda x: F.lower(x["side_data_type"]).contains(word))
    hdr = F.when(side("dolby vision") | side("dovi"), "Dolby Vision").when(side("hdr dynamic metadata") | side("2094"), "HDR10+").when(F.lower("__v.color_transfer") == "smpte2084", "HDR10").when(F.lower("__v.color_transfer") == "arib-std-b67", "HLG")
    chosen = F.coalesce(F.get(F.filter("audio", lambda a: a["default"]), F.lit(0)), F.get("audio", F.lit(0)))
    number = lambda c, kind: F.expr(f"try_cast({c} as {kind})")
    return parsed.withColumns({
        "container": F.split("__d.format.format_name", ",")[0], "duration": number("__d.format.duration", "double"), "bitrate": number("__d.format.bit_rate", "bigint"),
        "video_codec": F.col("__v.codec_name"), "width": F.col("__v.width"), "height": F.col("__v.height"), "hdr": hdr, "audio_codec": chosen["codec"],
    }).drop("__d", "__v")
