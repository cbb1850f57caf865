"""Dictionaries and labels: languages, channels, media types, times, names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

# Aliases of languages, names of channel counts, media types of extensions.
LANGUAGES = {"fr": "French", "fre": "French", "fra": "French", "french": "French", "en": "English", "eng": "English", "english": "English", "de": "German", "ger": "German", "deu": "German", "es": "Spanish", "spa": "Spanish", "it": "Italian", "ita": "Italian", "ja": "Japanese", "jpn": "Japanese"}
TAGS = {"French": "fr", "English": "en", "German": "de", "Spanish": "es", "Italian": "it", "Japanese": "ja"}
CHANNELS = {1: "Mono", 2: "Stereo", 6: "5.1", 7: "6.1", 8: "7.1"}
MEDIA_TYPES = {".mp4": "video/mp4", ".m4v": "video/mp4", ".mkv": "video/x-matroska", ".webm": "video/webm", ".avi": "video/x-msvideo", ".mov": "video/quicktime", ".ts": "video/mp2t", ".html": "text/html"}
OTHER_TYPE = "application/octet-stream"
# Names of codecs and containers.
CODECS = {"hevc": "HEVC (H.265)", "h264": "H.264", "av1": "AV1", "vp9": "VP9", "mpeg4": "MPEG-4 Part 2", "mpeg2video": "MPEG-2", "vc1": "VC-1", "ac3": "AC-3", "eac3": "E-AC-3", "dts": "DTS", "truehd": "TrueHD", "flac": "FLAC", "opus": "Opus", "vorbis": "Vorbis", "mp3": "MP3", "aac": "AAC", "pcm_s16le": "PCM"}
CONTAINERS = {"matroska": "Matroska (MKV)", "webm": "WebM", "avi": "AVI", "mpegts": "MPEG transport stream", "mpeg": "MPEG-PS", "asf": "ASF (WMV)", "ogg": "Ogg", "flv": "FLV", "mov": "MP4"}


def lookup(values: dict, key: Column, default: Column | None = None) -> Column:
    """A dictionary as a constant map; missing keys give ``default``."""
    found = F.try_element_at(F.create_map(*map(F.lit, chain(*values.items()))), key)
    return found if default is None else F.coalesce(found, default)


def language_label(code: Column) -> Column:
    return lookup(LANGUAGES, F.lower(F.trim(code)), F.lit("Unknown"))


def language_tag(code: Column) -> Column:
    """Two letters, ``und`` where unknown."""
    return lookup(TAGS, language_label(code), F.lit("und"))


def media_type(extension: Column) -> Column:
    """The media type of an extension with its dot, in either case."""
    return lookup(MEDIA_TYPES, F.lower(extension), F.lit(OTHER_TYPE))


def format_label(name: Column, labels: dict) -> Column:
    """What a codec or container (:data:`CODECS`, :data:`CONTAINERS`) is called; its own name where none is known."""
    return F.when(name.isNull(), "unknown").otherwise(lookup(labels, name, name))


def channel_label(n: Column) -> Column:
    return F.when(n.isNull(), F.lit(None)).otherwise(lookup(CHANNELS, n, F.concat(n.cast("string"), F.lit(" channels"))))


def episode_label(season: Column, first: Column, last: Column | None = None) -> Column:
    """``S01E02`` or ``S01E02-E03``."""
    one = F.format_string("S%02dE%02d", season, first)
    return one if last is None else F.when(last.isNull() | (last <= first), one).otherwise(F.concat(one, F.format_string("-E%02d", last)))


def remaining_label(position: Column, duration: Column) -> Column:
    """What is left, in minutes or hours and minutes; null if unknown or nothing."""
    minutes = F.floor(F.greatest(F.lit(0.0), duration - position) / 60 + 0.5).cast("int")
    hours, rest = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    long = F.when(rest == 0, F.format_string("%d h left", hours)).otherwise(F.format_string("%d h %02d left", hours, rest))
    return F.when((duration > 0) & (minutes > 0), F.when(minutes < 60, F.format_string("%d min left", minutes)).otherwise(long))


def clock(seconds: Column) -> Column:
    """``m:ss`` or ``h:mm:ss``."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), (s % 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def cue_time(seconds: Column) -> Column:
    """``hh:mm:ss.mmm``."""
    ms = F.floor(seconds * 1000 + 0.5).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000).cast("long"), F.floor(ms % 3600000 / 60000).cast("long"), F.floor(ms % 60000 / 1000).cast("long"), ms % 1000)


def parse_clock(text: Column) -> Column:
    """Seconds of ``h:mm:ss.cc``; null if it isn't that."""
    pattern = r"^\s*\d+:[0-5]?\d:[0-5]?\d(?:\.\d+)?\s*$"
    return once(lambda p: F.get(p, 0).cast("double") * 3600 + F.get(p, 1).cast("double") * 60 + F.get(p, 2).cast("double"), F.split(F.when(text.rlike(pattern), text), ":"))


def etag(size: Column, mtime: Column) -> Column:
    return F.concat(F.lower(F.hex(size)), F.lit("-"), F.lower(F.hex(mtime)))


def signature(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(32))


def dimensions(text: Column) -> Column:
    """Struct of width and height of ``WxH``; null if it isn't that."""
    return F.when(text.rlike("^[0-9]{1,9}x[0-9]{1,9}$"), F.struct(F.split(text, "x")[0].cast("int").alias("width"), F.split(text, "x")[1].cast("int").alias("height")))


def first_sentence(text: Column, least: int = 25) -> Column:
    """The first sentence of ``least`` characters or more, else the whole text."""
    found = F.regexp_extract(text, rf"(?s)^(.{{{least},}}?[.!?])(?:\s|$)", 1)
    return F.when(found != "", found).otherwise(text)
