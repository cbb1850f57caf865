"""Scans by ranges against windows by key and plain Python, with a key that is made to count as large."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import intervals, scans


@pytest.fixture(params=[10**9, 5])
def hot(request, monkeypatch):
    monkeypatch.setattr(scans, "HOT", request.param)


def points(spark, n=600, keys=3, seed=1, step=0.25, parts=4):
    rng = random.Random(seed)
    # one key has nearly all rows; many times are equal
    rows = [(i, rng.choice([0] * 10 + list(range(keys)) + [None]), rng.randrange(int(n / 3)) * step) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, k long, t double").repartition(parts)


def test_asof_and_nearest(spark, hot):
    left, a = points(spark, 300, seed=1)
    right, b = points(spark, 200, seed=2)
    got = {r["id"]: r["seen"] for r in intervals.asof(a, b.select("k", "t", F.col("t").alias("seen")), ["k"], "t", "seen").collect()}
    assert got == {i: max((t2 for _, k2, t2 in right if k2 == k and t2 <= t), default=None) for i, k, t in left}
    got = {r["id"]: r["nearest"] for r in intervals.nearest(a, b.select("k", "t"), ["k"], "t").collect()}
    assert got == {i: min((t2 for _, k2, t2 in right if k2 == k), key=lambda t2: (abs(t2 - t), t2), default=None) for i, k, t in left}


def test_next_and_numbers(spark, hot):
    rows, df = points(spark)
    by = {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        by.setdefault(k, []).append((i, t))
    number = {i: n for own in by.values() for n, (i, _) in enumerate(own)}
    gap = {i: own[n + 1][1] - t if n + 1 < len(own) else None for own in by.values() for n, (i, t) in enumerate(own)}
    got = scans.numbered(intervals.to_next(df, ["k"], ["t", "id"], "t", "gap"), ["k"], ["t", "id"], "n").collect()
    assert {r["id"]: (r["gap"], r["n"]) for r in got} == {i: (gap[i], number[i]) for i in number}


def test_runs_of_unknown_values_go_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(scans, "HOT", 5)
    rows = [(1, i, i if i in (3, 90) else None) for i in range(400)] + [(2, i, None) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    got = {(r["k"], r["t"]): r["x"] for r in scans.neighbour(df, ["k"], ["t"], "v", "x").collect()}
    assert got == {(k, t): None if k == 2 or t < 3 else 3 if t < 90 else 90 for k, t, _ in rows}
    assert scans.in_ranges(df, ["k"], ["t"]).filter("k = 1").select("__part").distinct().count() > 1


def greedy(times, target):
    out = []
    for t in sorted(set(times)):
        if not out or t - out[-1] >= target:
            out.append(t)
    return out


@pytest.mark.parametrize("step", [0.25, 0.1, 1 / 3])
def test_greedy_segments(spark, hot, step):
    rows, df = points(spark, 500, seed=7, step=step)
    df, rows = df.filter("k is not null"), [r for r in rows if r[1] is not None]
    for target in (0.3, 4.0):
        got = intervals.greedy_segments(df, "k", "t", F.first(F.lit(1000.0)), target).collect()
        mine = {}
        for r in got:
            mine.setdefault(r["k"], []).append((r["index"], r["start"], r["duration"]))
        third = lambda x: int(x * 1000 + 0.5) / 1000
        for k in {r[1] for r in rows}:
            starts = greedy([t for _, k2, t in rows if k2 == k], target)
            assert sorted(mine[k]) == [(i, third(s), third(e - s)) for i, (s, e) in enumerate(zip(starts, [*starts[1:], 1000.0], strict=True))]
