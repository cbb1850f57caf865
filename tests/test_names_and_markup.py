"""Glued words and caption markup on single values."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import glued, markup, naming


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


GLUED = {
    "TheHouseoftheRisingMoon": "The House of the Rising Moon",
    "TheKeepersofthenight2019MULTi1080p": "The Keepersofthenight 2019 MULTi 1080p",  # "night" is no function word
    "TheKeepersoftheLostKeys": "The Keepers of the Lost Keys",
    "RiverAStoneInWater1999": "River A Stone In Water 1999",
    "SpaceJourneyPartIX": "Space Journey Part IX",
    "MyStraNgestDaYs": "MyStraNgestDaYs",  # scraps: it stays
    "Highland": "Highland",
    "AnotherHighlandIsland": "Another Highl and Island",  # a long stem, so its ending is taken for a word
    "Abcdefghijklmnop": "Abcdefghijklmnop",
    "Two.Words_and more": "Two Words and more",
    "ABCLavieestunlongfleuvetranquilleetla1080p": "ABC Lavieestunlongfleuvetranquilleetla 1080p",  # what would be left is too long
    "": "",
    "  ": "",
}


def test_glued_words(spark):
    assert values(spark, glued.segment, [*GLUED, None]) == [*GLUED.values(), None]


def test_glued_names_are_parsed(spark):
    got = values(spark, naming.parse_movie, ["TheHouseoftheRisingMoon2019MULTi2160p10bitHDR.mkv", "TheKeepersoftheLostKeys (2001).mkv", "a/RiverAStoneInWater.mkv"])
    assert [(r["title"], r["year"]) for r in got] == [("The House of the Rising Moon", 2019), ("The Keepers of the Lost Keys", 2001), ("River A Stone In Water", None)]


def styled(raw):
    """Overrides to tags, worked off by a plain loop."""
    import re

    if re.search(r"\\p[1-9]", raw):
        return None
    text, out, open_ = raw.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"), "", []
    while text:
        m = re.match(r"\{([^}]*)\}", text)
        if not m:
            cut = text.find("{", 0) if text[0] != "{" else len(text)
            cut = len(text) if cut < 0 else cut
            out, text = out + text[:cut], text[cut:]
            continue
        text = text[m.end() :]
        for command in filter(None, m[1].split("\\")):
            s = re.fullmatch(r"([iu])([01])|(b)(\d+)", command)
            if command.startswith("r"):
                out, open_ = out + "".join(f"</{x}>" for x in reversed(open_)), []
            elif s:
                name, on = s[1] or s[3], int(s[2] or s[4]) != 0
                if on and name not in open_:
                    out, open_ = out + f"<{name}>", [*open_, name]
                elif not on and name in open_:
                    at = open_.index(name)
                    above = open_[at + 1 :]
                    out += "".join(f"</{x}>" for x in reversed(above)) + f"</{name}>" + "".join(f"<{x}>" for x in above)
                    open_ = open_[:at] + above
    out += "".join(f"</{x}>" for x in reversed(open_))
    out = re.sub(r"\\([{}])", r"\1", re.sub(r"\\h", " ", re.sub(r"\\[Nn]", "\n", out)))
    return "\n".join(line.strip() for line in out.split("\n")).strip() or None


def test_overrides_become_tags(spark):
    import random

    rng = random.Random(4)
    parts = ["{\\i1}", "{\\i0}", "{\\b700}", "{\\b0}", "{\\u1\\i1}", "{\\u0}", "{\\r}", "{\\rStyle}", "{\\an8\\pos(1,2)}", "{note}", "one", " two ", "\\N", "\\h", "<&>", "{", "}", "\\{", "é", "{\\b1\\u1\\i1}", "{\\b0\\i0}"]
    texts = ["", "  ", "{\\fad(1,2)}", "{\\p1}m 0 0{\\p0}", "a { b", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400))]
    assert values(spark, markup.overrides_to_tags, texts) == [styled(t) for t in texts]


FOREIGN = {
    "{\\an8}Up here": "Up here",
    "{a real brace}": "{a real brace}",
    "{\\fad(1,2)\\1a&H0&}left{\\r} right": "left right",
    '<font color="cyan">sea</font>': "<c.cyan>sea</c>",
    "<FONT face='x' color = 'Red'>R</FONT>": "<c.red>R</c>",
    '<font color="#aabbcc">x</font>': "<c>x</c>",
    "<font size=2>x</font>": "<c>x</c>",
    "<div><p class='q'>kept</p></div>": "kept",
    "<i>a</i><B>b</B><v Ann>c": "<i>a</i><B>b</B><v Ann>c",
    "1 < 2 and <3>": "1 < 2 and <3>",
    "": "",
}


def test_foreign_tags_are_cleared(spark):
    assert values(spark, markup.clear_foreign_tags, [*FOREIGN]) == [*FOREIGN.values()]


@pytest.mark.parametrize("before,after", [
    ("﻿1\r\n00:00:01,5 --> 00:00:02,000\r\n<span>Hi</span>\r\n", "WEBVTT\n\n1\n00:00:01.5 --> 00:00:02.000\nHi\n"),
    ("WEBVTT\n\n00:01.000 --> 00:02.000\n<u>x</u><em>y", "WEBVTT\n\n00:01.000 --> 00:02.000\n<u>x</u>y"),
])
def test_stamped_documents(spark, before, after):
    assert values(spark, markup.stamped_to_captions, [before]) == [after]
