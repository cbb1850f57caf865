"""The first matches found with thresholds and bounds against all pairs that share a word."""

import random

import pytest

from vellum.operators import matching

TITLES = "cid long, title string, year int, popularity double"
QUERIES = "qid long, q_title string, q_year int"


def made(seed, words, titles, queries, longest):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(words))]
    name = lambda: " ".join(rng.choices(words, weights, k=rng.randrange(1, longest)))
    known = [(i, rng.choice([name(), name(), "", None]) if i % 40 == 0 else name(), rng.choice([None, 1990, 1991, 1992, 1993]), rng.choice([None, 1.0, 2.0, float(i % 7)])) for i in range(titles)]
    known += [(titles + i, "Shared Name", 1990 + i % 3, float(i % 4)) for i in range(60)]  # many of one name
    asked = [(i, rng.choice([name(), rng.choice(known)[1], "Shared Name", "l'Été d'Or"]), rng.choice([None, 1990, 1991, 2005])) for i in range(queries)]
    asked += [(queries, None, 1990), (queries + 1, "", None), (queries + 2, "no such word", 1991), (queries + 3, "Shared name", None)]
    return asked, known


@pytest.mark.parametrize("seed,words,longest", [(1, ["red", "moon", "of", "the", "l'été", "d'or", "ete", "or", "l"], 5), (2, [f"w{i}" for i in range(30)], 9), (3, ["a", "b", "c"], 4)])
def test_best_is_what_all_pairs_give(spark, seed, words, longest):
    asked, known = made(seed, words, 250, 60, longest)
    q, t = spark.createDataFrame(asked, QUERIES), spark.createDataFrame(known, TITLES)
    columns = ["qid", "cid", "place", "confidence", "similarity", "exact", "reason", "confident"]
    want = matching.decide(matching.score(matching.candidates(q, t))).select(columns).collect()
    got = matching.best(q, t).select(columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 150


def test_best_of_nothing(spark):
    asked, known = made(1, ["a"], 5, 3, 2)
    q, t = spark.createDataFrame(asked, QUERIES), spark.createDataFrame(known, TITLES)
    assert matching.best(q.filter("qid < 0"), t).count() == 0
    assert matching.best(q, t.filter("cid < 0")).count() == 0
