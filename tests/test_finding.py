"""Searches by postings and pages by ranges against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.operators import paging, search


def texts(n=400, seed=3):
    rng = random.Random(seed)
    words = ["the", "red", "house", "housing", "river", "rivers", "a", "ab", "abc", "thé", "x1", "aaaa", "aaa"]
    return [(i, None if i % 50 == 7 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))) for i in range(n)]


WANTED = ["hous", "the r", "a", "ab abc", "é", "aaaa", "aaaaa", "iver red", "zzz", "hous zzz", "x1 a", "s r", "aa aaa aaaa"]


def contains(rows, wanted):
    return {i for i, t in rows if t is not None and all(w in t for w in wanted.split())}


def test_searches(spark, tmp_path):
    rows = texts()
    df = spark.createDataFrame(rows, "id long, key string").repartition(3)
    index = search.postings(df, "id", "key")
    asked = spark.createDataFrame(list(enumerate([*WANTED, "", "  ", None])), "sid int, wanted string")
    got = {(r["sid"], r["id"]) for r in search.search_all(index, df, "id", "key", asked).collect()}
    assert got == {(s, i) for s, w in enumerate(WANTED) for i in contains(rows, w)}
    search.write_postings(df, "id", "key", str(tmp_path / "grams"))
    written = search.read_postings(spark, str(tmp_path / "grams"))
    for w in WANTED[:6]:
        assert {r["id"] for r in search.search(written, df, "id", "key", w).collect()} == contains(rows, w)
    plan = search.search(written, df, "id", "key", "hous")._jdf.queryExecution().toString()
    assert "PartitionFilters: [b#" in plan
    assert search.search(written, df, "id", "key", " ").count() == len(rows)


def test_searches_meet_texts_once(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "id long, key string").repartition(3)
    asked = spark.createDataFrame([(1, "hous"), (1, "red ab"), (2, "a")], "sid int, wanted string")
    found = search.search_all(search.postings(df, "id", "key"), df, "id", "key", asked)
    got = sorted((r["sid"], r["id"]) for r in found.collect())
    assert got == sorted((s, i) for s, w in ((1, "hous"), (1, "red ab"), (2, "a")) for i in contains(rows, w))
    # pairs that are no match are not gathered by search and text
    assert not re.search(r"keys=\[sid#\d+L?, id#\d+L?\]", found._jdf.queryExecution().toString())


@pytest.mark.parametrize("ranges", [1, 7])
def test_pages(spark, ranges):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "a", "b", "c"]), rng.randrange(9)) for i in range(333)]
    df = spark.createDataFrame(rows, "id int, k string, v int").repartition(5)
    pages = paging.Pages(df, [F.col("k").desc_nulls_last(), F.col("v"), F.col("id")], ranges)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -ord(r[1] or "a"), r[2], r[0]))]
    assert pages.total == 333 and pages.count(50) == 7
    for number in range(1, 9):
        assert [r["id"] for r in pages.page(number, 50).collect()] == want[(number - 1) * 50 : number * 50]
    none = paging.Pages(df.filter("id < 0"), [F.col("id")], ranges)
    assert none.count(50) == 1 and none.page(1, 50).count() == 0
