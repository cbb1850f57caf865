"""Names parsed: literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.functions import naming
from vellum.operators import playback


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path, title, year",
    [
        ("Blade.Runner.2049.2017.2160p.UHD.BluRay.x265.mkv", "Blade Runner 2049", 2017), ("2012.2009.1080p.BluRay.x264.mkv", "2012", 2009), ("French.Kiss.1995.1080p.BluRay.mkv", "French Kiss", 1995), ("Web Therapy (2011)/x.mkv", "Web Therapy", 2011),
        ("Action/Heat.1995.mkv", "Heat", 1995), ("Spider-Man.mkv", "Spider-Man", None), ("[GRP] Dune [2021] {edition}.mkv", "Dune", 2021), ("Amélie.VOSTFR.mkv", "Amélie", None),
    ],
)
def test_movie(spark, path, title, year):
    got = value(spark, naming.parse_movie(F.lit(path), max_year=2030))
    assert (got["title"], got["year"]) == (title, year)


def test_no_movie(spark):
    assert value(spark, naming.parse_movie(F.lit("1080p.BluRay.x264-GRP.mkv"))) is None


@pytest.mark.parametrize(
    "path, want",
    [
        ("Lost (2004)/Season 01/Lost - S01E02 - Pilot.mkv", ("Lost", 2004, 1, 2, None, "Pilot", "folder")), ("Lost/Saison 1/Lost - 1x02.mkv", ("Lost", None, 1, 2, None, None, "folder")), ("Lost/S01/Episode 02 - Title.mkv", ("Lost", None, 1, 2, None, "Title", "folder")),
        ("Lost/Saison 1/01 - Title.mkv", ("Lost", None, 1, 1, None, "Title", "folder")), ("Lost.S01E01-E02.1080p.WEB-DL.x264-GRP.mkv", ("Lost", None, 1, 1, 2, None, "file")), ("Show/Specials/Show - E03.mkv", ("Show", None, 0, 3, None, None, "folder")),
        ("24.S01E01 - 24 heures.mkv", ("24", None, 1, 1, None, "24 heures", "file")), ("Show.S03E25.FiNAL.MULTi.1080p.mkv", ("Show", None, 3, 25, None, None, "file")),
    ],
)
def test_episode(spark, path, want):
    assert tuple(value(spark, naming.parse_episode(F.lit(path), max_year=2030))) == want


def test_no_episode(spark):
    assert value(spark, naming.parse_episode(F.lit("Lost/extra.mkv"))) is None


@pytest.mark.parametrize("name, video, want", [("film.en.forced.srt", "film.mkv", ("en", True, False)), ("Le film en Francais.srt", "other.mkv", ("fr", False, False)), ("film.srt", "film.mkv", (None, False, False)), ("film.eng.sdh.srt", "film.mkv", ("en", False, True))])
def test_subtitle(spark, name, video, want):
    assert tuple(value(spark, naming.parse_subtitle(F.lit(name), F.lit(video)))) == want


def test_probe(spark):
    doc = {
        "format": {"format_name": "matroska,webm", "duration": "61.5", "bit_rate": "x"},
        "streams": [
            {"index": 0, "codec_type": "video", "codec_name": "mjpeg", "disposition": {"attached_pic": 1}}, {"index": 1, "codec_type": "video", "codec_name": "hevc", "width": 1920, "height": 1080, "color_transfer": "smpte2084"},
            {"index": 2, "codec_type": "audio", "codec_name": "dts", "channels": 6, "tags": {"LANGUAGE": "eng"}}, {"index": 3, "codec_type": "audio", "codec_name": "aac", "channels": 2, "tags": {"language": "fre"}, "disposition": {"default": 1}},
        ],
    }
    r = playback.flatten_probe(spark.createDataFrame([(1, json.dumps(doc))], "id int, doc string"), "doc").first()
    assert (r["container"], r["duration"], r["bitrate"], r["video_codec"], r["height"], r["hdr"], r["audio_codec"]) == ("matroska", 61.5, None, "hevc", 1080, "HDR10", "aac")
    assert [a["language"] for a in r["audio"]] == ["eng", "fre"] and r["subtitles"] == []


def test_modes(spark):
    mode = lambda *a: value(spark, playback.decide(*(F.lit(x).cast("string") for x in a)))
    assert mode(".mp4", "mp4", "h264", "aac")["mode"] == "direct"
    assert mode(".mkv", "matroska", "h264", "dts")["reason"] == "audio is dts and container is matroska"
    assert [mode(".mkv", "matroska", v, "aac")["mode"] for v in ("hevc", "prores")] == ["transcode", "unsupported"]
    assert mode(".mkv", None, None, None)["mode"] == "unsupported"
