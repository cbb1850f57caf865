"""Literal cases of the functions and operators."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import labels, text
from vellum.operators import documents, intervals, matching, merge


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "title, key",
    [("Amélie", "amelie"), ("AMELIE", "amelie"), ("Ame\u0301lie", "amelie"), ("Ocean's Eleven", "oceans eleven"), ("Fast & Furious", "fast and furious"), ("Le.Roi.Lion", "le roi lion"), ("  ", ""), ("Čapek-Ő", "capek o")],
)
def test_title_key(spark, title, key):
    assert value(spark, text.title_key(F.lit(title))) == key


@pytest.mark.parametrize("title, key", [("Le Roi Lion", "roi lion"), ("The Matrix", "matrix"), ("The", "the"), ("L'été", "lete")])
def test_sort_title(spark, title, key):
    assert value(spark, text.sort_title(F.lit(title))) == key


@pytest.mark.parametrize("a, b, s", [("Dune", "Titanic", 0.0), ("Amélie", "AMELIE", 1.0), ("À l'ancienne", "A l ancienne", 1.0), ("", "x", 0.0)])
def test_similarity(spark, a, b, s):
    assert value(spark, text.title_similarity(F.lit(a), F.lit(b))) == s


@pytest.mark.parametrize(
    "header, size, kind, start, end",
    [
        (None, 10, "full", None, None), ("items=0-1", 10, "full", None, None), ("bytes=0-", 10, "partial", 0, 9), ("bytes=2-5", 10, "partial", 2, 5), ("bytes=-3", 10, "partial", 7, 9), ("bytes=-30", 10, "partial", 0, 9),
        ("bytes=-0", 10, "unsatisfiable", None, None), ("bytes=10-", 10, "unsatisfiable", None, None), ("bytes=5-3", 10, "unsatisfiable", None, None), ("bytes=0-99", 10, "partial", 0, 9),
        ("bytes=1e3-", 10, "full", None, None), ("bytes=0-1,3-4", 10, "full", None, None), ("bytes=0-", 0, "unsatisfiable", None, None), ("bytes=5", 10, "full", None, None), ("bytes=-", 10, "full", None, None),
    ],
)
def test_byte_range(spark, header, size, kind, start, end):
    got = value(spark, text.byte_range(F.lit(header).cast("string"), F.lit(size).cast("long")))
    assert (got["kind"], got["start"], got["end"]) == (kind, start, end)


def test_labels(spark):
    assert value(spark, labels.remaining_label(F.lit(0.0), F.lit(2160.0))) == "36 min left"
    assert value(spark, labels.remaining_label(F.lit(0.0), F.lit(4320.0))) == "1 h 12 left"
    assert value(spark, labels.remaining_label(F.lit(10.0), F.lit(None).cast("double"))) is None
    assert value(spark, labels.parse_clock(F.lit("1:02:03.50"))) == 3723.5
    assert value(spark, labels.parse_clock(F.lit("x"))) is None
    assert value(spark, labels.cue_time(F.lit(3723.5))) == "01:02:03.500"
    assert value(spark, labels.dimensions(F.lit("1920x1080")))["height"] == 1080
    assert value(spark, labels.dimensions(F.lit("1920"))) is None


def segments(spark, times, duration, target):
    df = spark.createDataFrame([(1, float(t)) for t in times], "k int, t double")
    rows = intervals.greedy_segments(df, "k", "t", F.first(F.lit(float(duration))), float(target)).orderBy("index").collect()
    return [r["start"] for r in rows], [r["duration"] for r in rows]


def test_greedy_segments(spark):
    assert segments(spark, [0, 2, 4, 6, 8, 10, 12], 14, 4) == ([0, 4, 8, 12], [4, 4, 4, 2])
    assert segments(spark, [0, 10, 20, 29.96, 32.17, 42.13], 50, 4)[0] == [0, 10, 20, 29.96, 42.13]


def test_tilings(spark):
    assert [(r["start"], r["duration"]) for r in value(spark, intervals.tiling(F.lit(11.0)))] == [(0, 2), (2, 2), (4, 2), (6, 4), (10, 1)]
    assert value(spark, intervals.tiling(F.lit(0.0))) is None
    assert [(r["start"], r["duration"]) for r in value(spark, intervals.tiling_merged_tail(F.lit(16.5)))] == [(0, 8), (8, 8.5)]


def test_nearest_and_gap(spark):
    a = spark.createDataFrame([(1, 5.0), (1, 1.0), (1, 30.0), (2, 1.0)], "k int, t double")
    b = spark.createDataFrame([(1, 0.0), (1, 10.0)], "k int, t double")
    assert {(r["k"], r["t"]): r["nearest"] for r in intervals.nearest(a, b, ["k"], "t").collect()} == {(1, 5.0): 0.0, (1, 1.0): 0.0, (1, 30.0): 10.0, (2, 1.0): None}
    g = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 1)], "k int, i int")
    assert {r["k"]: r["first_gap"] for r in intervals.first_gap(g, "k", "i").collect()} == {1: 2, 2: 0}


def test_queue(spark):
    queue = spark.createDataFrame([], "id int, status string, attempts int, fingerprint string")
    targets = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, fingerprint string")
    first = merge.enqueue(queue, targets, ["id"])
    assert [r["outcome"] for r in first.collect()] == ["added"] * 3
    again = merge.enqueue(first.drop("outcome"), targets, ["id"])
    assert [r["outcome"] for r in again.collect()] == ["unchanged"] * 3


def test_match_years(spark):
    q = spark.createDataFrame([(1, "Dune", 2020), (2, "Dune", 1984), (3, "Dune", None)], "qid int, q_title string, q_year int")
    c = spark.createDataFrame([(7, "Dune", 2021, 1.0), (8, "Titanic", 2020, 9.0)], "cid int, title string, year int, popularity double")
    best = {r["qid"]: (r["cid"], r["confidence"], r["confident"]) for r in matching.decide(matching.score(matching.candidates(q, c))).collect()}
    assert best == {1: (7, 0.85, True), 2: (7, 0.45, False), 3: (7, 0.85, True)}


def test_common_directory(spark):
    df = spark.createDataFrame([(1, "D:\\S\\Saison 1\\E01.mkv"), (1, "D:\\S\\Saison 10\\E01.mkv"), (2, "/a/b/c"), (3, "x/1"), (3, "y/1")], "k int, p string")
    assert {r["k"]: r["d"] for r in documents.common_directory(df, ["k"], "p", "d").collect()} == {1: "D:/S", 2: "/a/b", 3: None}


def test_subtitle_script(spark):
    script = "[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:02.00,0:00:03.50,Two, {\\i1}with comma\\Nand <b>\nDialogue: 0,0:00:01.00,0:00:01.50,One\nDialogue: 0,0:00:05.00,0:00:04.00,Backwards\n"
    cues = documents.cues(spark.createDataFrame([(1, script), (2, None)], "id int, t string"), "id", "t")
    assert [(r["nth"], r["start"], r["end"], r["text"]) for r in cues.orderBy("nth").collect()] == [(0, 1.0, 1.5, "One"), (1, 2.0, 3.5, "Two, {\\i1}with comma\\Nand <b>")]
    caption = documents.web_captions(cues, "id").first()["document"]
    assert caption == "WEBVTT\n\n00:00:01.000 --> 00:00:01.500\nOne\n\n00:00:02.000 --> 00:00:03.500\nTwo, <i>with comma\nand &lt;b&gt;</i>\n"


def test_scripts_are_dealt_out_and_may_lack_a_format(spark):
    scripts = [(1, "[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,Before any format\nFormat: Start, End, Text\nDialogue: 0:00:03.00,0:00:04.00,After, it"), (2, "[Events]\nDialogue: x")]
    cues = documents.cues(spark.createDataFrame(scripts, "id int, t string").coalesce(1), "id", "t")
    assert [tuple(r) for r in cues.collect()] == [(1, 0, 3.0, 4.0, "After, it")]
    assert "RepartitionByExpression [id" in cues._jdf.queryExecution().optimizedPlan().toString()


def test_overrides_are_worked_out_once(spark):
    cues = spark.createDataFrame([(1, 0, 1.0, 2.0, "{\\i1}a"), (1, 1, 3.0, 4.0, "{\\p1}m 0 0"), (2, 0, 1.0, 2.0, "{\\an8}")], "id int, nth int, start double, end double, text string")
    captions = documents.web_captions(cues, "id")
    assert [tuple(r) for r in captions.collect()] == [(1, "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<i>a</i>\n")]
    assert captions._jdf.queryExecution().optimizedPlan().toString().count("\\p[1-9]") == 1
