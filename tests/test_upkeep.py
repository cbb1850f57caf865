"""Literal cases and plain-Python twins of paths, titles, synopses and folds."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vellum.functions import text, tracks, video
from vellum.operators import fold, matching, paths, upkeep


def one(spark, column, *values):
    kinds = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], kinds).select(column(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


def test_path_keys(spark):
    assert one(spark, text.path_key, "Vide\u0301os/FILMS") == one(spark, text.path_key, "Vidéos/films") == "vidéos/films"
    assert one(spark, text.nfc, None) is None


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("\\\\NAS\\Vidéos\\films\\A b.mkv", "/mnt/films/A b.mkv"), ("\\\\nas\\VIDE\u0301OS\\films", "/mnt/films"), ("\\\\NAS\\Vidéos\\films-bonus\\x", "/mnt/all/films-bonus/x"),
        ("//NAS/Vidéos//other/y", "/mnt/all/other/y"), ("/elsewhere/x", None), (None, None), ("", None),
    ],
)
def test_remap(spark, path, want):
    mappings = spark.createDataFrame([("\\\\NAS\\Vidéos", "/mnt/all/"), ("\\\\NAS\\Vidéos\\films\\", "/mnt/films"), ("", "/none")], "source string, target string")
    rows = spark.createDataFrame([(1, path)], "id int, path string")
    assert paths.remap(rows, mappings, "path").first()["new_path"] == want


def test_mappings(spark):
    got = one(spark, paths.parse_mapping, " D:\\a=b => /srv/x ")
    assert (got["source"], got["target"]) == ("D:\\a=b", "/srv/x")
    assert one(spark, paths.parse_mapping, "no arrow") is None
    assert one(spark, paths.mapping_fault, "a", "/b") is None and one(spark, paths.mapping_fault, "a", "b") == "the target is not absolute"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("darkino com-1141515- The Film", "The Film"), ("www2.tirexo.art-4242- Film", "www2 Film"), ("Film - Wawacity", "Film"), ("Zone-Telechargement.com - Film", "Film"), ("My yts story", "My yts story"),
    ],
)
def test_release_sites(spark, raw, want):
    assert one(spark, text.strip_release_sites, raw) == want


@pytest.mark.parametrize(
    ("raw", "told", "marks"),
    [
        (None, None, []), ("", None, []), ("| Original |*", None, ["VO"]), ("FR VFQ : AC3 5.1", None, ["VFQ"]), ("Na'vi parts only", "Na'vi parts only", []), ("VFF VF commentary", None, ["VFF", "Commentaires"]),
        ("Дублированный", None, []), ("x" * 50, "x" * 41 + "…", []), ("DTS-HD MA 7.1 @ 1509 kb/s", None, []),
    ],
)
def test_track_titles(spark, raw, told, marks):
    assert one(spark, tracks.informative_title, raw) == told and one(spark, tracks.title_markers, raw) == marks


def synopsis(text, limit=150):
    clean = re.sub(r"\s+", " ", text).strip()
    sentence = clean
    for m in re.finditer("[.!?…]+", clean):
        if (clean[m.end() :] == "" or clean[m.end()] == " ") and m.end() >= 25:
            sentence = clean[: m.end()]
            break
    if sentence == "" or len(sentence) <= limit:
        return sentence or None
    window = sentence[:limit]
    cut = max(i for i in (window.rfind(c) for c in ",;:—–"))
    cut = cut if cut >= limit * 0.55 else window.rfind(" ")
    return re.sub(r"[\s.,;:!?—–]+$", "", window[: cut if cut >= 0 else len(window)]) + "…"


def test_short_synopses(spark):
    rng = random.Random(3)
    parts = ["word", "a", ",", ";", " ", " ", ".", "...", "!", "3.5", "—", "\n", "longerword", "é"]
    texts = ["", "  ", "Short.", "x" * 200, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 120))) for _ in range(400))]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", text.short_synopsis(F.col("t")).alias("s")).collect()
    assert {r["id"]: r["s"] for r in got} == {i: synopsis(t) for i, t in enumerate(texts)}


def test_throttling(spark):
    rng = random.Random(4)
    rows = [(k, f"u{rng.randint(0, 4)}", rng.randint(0, 300), rng.uniform(0, 30)) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, user string, at int, value double").withColumn("ts", F.timestamp_seconds("at"))
    got = {r["id"] for r in fold.throttled(df, "user", "ts", "value", seconds=10, moved=5, tie="id").collect()}
    want, last = set(), {}
    for k, user, at, value in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if user not in last or (at - last[user][0] >= 10 and abs(value - last[user][1]) >= 5):
            last[user] = (at, value)
            want.add(k)
    assert got == want


def test_queue_actions(spark):
    queue = spark.createDataFrame([(1, "pending", 0, None), (2, "running", 1, "old"), (3, "pending", 2, None), (4, "done", 1, None)], "id int, status string, attempts int, error string")
    assert sorted(tuple(r) for r in upkeep.claim(queue, 1, [F.desc("attempts")]).select("id", "status", "attempts").collect()) == [(1, "pending", 0), (2, "running", 1), (3, "running", 3), (4, "done", 1)]
    results = spark.createDataFrame([(1, "requeue", None), (2, "complete", None), (3, "fail", "no disk")], "id int, action string, reason string")
    assert sorted(tuple(r) for r in upkeep.settle(queue, results).collect()) == [(1, "pending", 0, None), (2, "done", 1, None), (3, "failed", 2, "no disk"), (4, "done", 1, None)]


def test_geometry(spark):
    df = spark.createDataFrame([(3840, 2160), (1906, 1084), (0, 10), (None, 1080)], "w int, h int")
    got = df.select(video.output_size(F.col("w"), F.col("h"), F.lit(1080)).alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in got] == [(1920, 1080), (1906, 1084), None, None]
    assert unicodedata.normalize("NFC", "e\u0301") == "é"


def test_refined_matches(spark):
    queries = spark.createDataFrame([(1, "the blue anvil", 1999), (2, "red rope", 1999), (3, "green hat", None)], "qid int, q_title string, q_year int")
    known = [(10, "anvil azure", 1999, 5.0), (11, "blue box", 1998, 9.0), (12, "red rope", 1999, 1.0), (13, "hat", 1999, 1.0), (14, "anvil shop", 1999, 1.0), (15, "anvil song", 1999, 9.0), (16, "anvil story", 1999, 0.5)]
    titles = spark.createDataFrame(known, "cid int, title string, year int, popularity double")
    others = spark.createDataFrame([(10, "The Blue Anvil"), (10, "nothing alike"), (11, "the blue anvil"), (12, "x"), (16, "the blue anvil")], "cid int, other string")
    decided = matching.decide(matching.score(matching.candidates(queries, titles)))
    got = {(r["qid"], r["cid"]): (r["place"], r["confidence"], r["confident"]) for r in matching.refine(decided, others).collect()}
    # exact by another title and of the same year; one of another year and the fourth of the year are not asked
    assert got[1, 10] == (1, 1.0, True) and got[1, 11][1] < 0.8 and got[1, 16][1] < 0.8
    assert got[2, 12] == (1, 1.0, True) and got[3, 13][1] == {(r["qid"], r["cid"]): r["confidence"] for r in decided.collect()}[3, 13]
