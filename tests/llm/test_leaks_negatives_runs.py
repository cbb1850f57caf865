"""Decontamination, hard negatives and periodic runs against brute force, on small tables with odd rows."""

import math
import random
import re
import time

import duckdb
import pytest

from vellum.llm import decontamination, hard_negatives, line_dedup, periodic_runs, quality, registry, simhash

SF = "/root/testdata/sf0.001"
#: Clashing names: operators use them inside or for results.
EXTRA = ", id int, key string, items string, ranges int, r string, i int, w string, v int, n int, words int, runs string, best int, found string"
MORE = (1, "k", "i", 2, "r", 3, "w", 4, 5, 6, "r", 7, "f")

LETTERS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def leaks(text, items, window=10):
    """Words, hit words, ids of items, and characters of the stretches hit, by trying every place."""
    found = list(LETTERS.finditer(lowered(text)))
    words = [m[0] for m in found]
    hit, ids = [False] * len(words), set()
    for item, t in items:
        own = LETTERS.findall(lowered(t))
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit[i : i + size] = [True] * size
                ids.add(item)
    spans = []
    for i, m in enumerate(found):
        if hit[i]:
            if i and hit[i - 1]:
                spans[-1] = (spans[-1][0], m.end())
            else:
                spans.append((m.start(), m.end()))
    return len(words), sum(hit), len(ids), sorted(str(i) for i in ids if i is not None), spans


def some_texts():
    rng = random.Random(3)
    words = ["la", "le", "Été", "don't", "x9", "日本", "ÉTÉ", "of"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 10, 12, 30])))) for i in range(20)]
    items += [(100, None), (101, ""), (102, " ... "), (None, "no id here but ten words that are enough for one window"), (7, "the second text of item seven has more than ten words in it"), (11, items[11][1])]
    docs = [(1, None), (2, ""), (3, " \n"), (4, items[5][1]), (4, items[5][1]), (None, "x " + items[6][1]), (5, "Before!\n" + items[7][1].upper().replace("É", "é") + ", (after)")]
    docs += [(6, items[23][1].replace(" ", " -- ")), (7, items[24][1][4:]), (8, " ".join(t for _, t in items if t) * 3), (9, "z" * 50_000 + " " + items[8][1]), (10, "\x00".join(items[9][1].split()))]
    docs += [(20 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("block", [None, 900])
def test_leaks(spark, block):
    docs, items = some_texts()
    d = spark.createDataFrame([(*r, *MORE) for r in docs], "doc_id long, text string" + EXTRA).repartition(3)
    b = spark.createDataFrame([(*r, *MORE) for r in items], "item_id long, text string" + EXTRA)
    got = decontamination.scan(d, b, block_chars=block).collect()
    rows = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["items"], [tuple(s) for s in r["spans"]]) for r in got), key=repr)
    assert rows == sorted(((i or 0, *leaks(t, items)) for i, t in docs), key=repr)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    assert sum(r["n_hit"] > 0 for r in got) > 10


def test_leaks_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.scan(d.filter("doc_id < 0"), b).count() == 0
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in decontamination.scan(d, b.filter("item_id < 0")).orderBy("doc_id").collect()] == [(3, 0, []), (0, 0, [])]


def test_leaks_of_a_very_long_text(spark):
    rng = random.Random(8)
    item = " ".join(f"w{rng.randrange(50)}" for _ in range(40))
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(200_000)) + " " + item + " end"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = decontamination.scan(d, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert got["n_hit"] == 40 and tuple(got["spans"][0]) == (len(text) - len(item) - 4, len(text) - 4)


def negatives(rows, anchors=lambda i: i % 100 == 0, positives=5, k=10):
    fit = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[2], r[1])):
        fit.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (label, v) in fit.items():
        if not anchors(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in fit.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:positives]:
            mine = [(n, i) for n, i, other in scores if other != label and 30 * -s <= 100 * -n <= 90 * -s][:k]
            out += [(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(mine, 1)]
    return sorted(out)


def vectors(n, width=6, labels=3, seed=1, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.4, spread) for _ in range(width)], rng.randrange(labels)) for i in range(n)]
    same = [0.5] * width
    rows += [(1000 + i, same, rng.randrange(labels)) for i in range(300)]  # a vector that very many have
    return rows


def mined(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("block,spread", [(None, 1.0), (2, 1.0), (3, 200.0)])
def test_hard_negatives(spark, block, spread):
    rows = vectors(400, spread=spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = mined(hard_negatives.mine(df, block=block))
    assert got == negatives(rows) and len(got) > 100


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(150) + [(None, [1.0] * 6, 1), (200, None, 1), (300, [1.0] * 6, None), (400, [1.0, None] * 3, 1), (500, [nan] * 6, 1), (600, [1.0, inf] * 3, 1), (700, [-inf] * 6, 2)]
    rows += [(100, [0.1] * 6, 2), (100, [0.1] * 6, 2), (800, [-1.0] * 6, 9), (900, [0.0] * 6, 0)]  # one id with two vectors; a label of one row; nothing but zeros
    df = spark.createDataFrame([(*r, *MORE) for r in rows], "vec_id long, embedding array<double>, label int" + EXTRA).repartition(3)
    assert mined(hard_negatives.mine(df)) == negatives(rows)
    assert hard_negatives.mine(df.filter("vec_id < 0")).count() == 0
    short = [(0, [1.0, 1.0], 0), (1, [1.0], 0), (2, [0.5, 0.25, 3.0], 1), (3, [], 1)]
    padded = [(i, v + [0.0] * (3 - len(v)), n) for i, v, n in short]
    assert mined(hard_negatives.mine(spark.createDataFrame(short, "vec_id long, embedding array<double>, label int"))) == negatives(padded)


def test_hard_negatives_of_large_numbers(spark):
    """Sums beyond 2**53 are exact; sums beyond 64 bits are an error."""
    rows = [(i, [x * 2.0**19 + i for x in v], n) for i, v, n in vectors(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = mined(hard_negatives.mine(df))
    assert got == negatives(rows) and max(r[4] for r in got) > 1 << 53
    with pytest.raises(ArithmeticError):
        hard_negatives.mine(spark.createDataFrame([(0, [2.0**40], 1)], "vec_id long, embedding array<double>, label int"))


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                size = j - i + q
                if size >= max(6, 4 * q):
                    found.setdefault((i, size), q)
            i = j + 1
    return sorted((s, q, size) for (s, size), q in found.items())


def test_runs_of_many_sequences():
    rng = random.Random(11)
    for _ in range(1500):
        words = [rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randrange(0, 12))]
        for _ in range(rng.randrange(0, 4)):
            root = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
            words += root * rng.randrange(1, 7) + root[: rng.randrange(len(root) + 1)] + [rng.choice("abcd") for _ in range(rng.randrange(0, 6))]
        want = brute_runs(words)
        assert periodic_runs.runs(words) == want
        assert periodic_runs.runs_of([w.encode() for w in words]) == want


def test_places_are_an_ordered_set(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_CHUNK", 4)
    order = list(range(200))
    random.Random(2).shuffle(order)
    places, there = periodic_runs.Places(order[0]), [order[0]]
    for x in order[1:]:
        assert places.add(x) == (max((y for y in there if y < x), default=None), min((y for y in there if y > x), default=None))
        there.append(x)
        assert list(places) == sorted(there) and places.size == len(there)


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a a a a a"), (5, "a a a a a a"), (6, "x " + "b c\t" * 9 + "y"), (6, "x " + "b c\t" * 9 + "y"), (None, "é è " * 5), (7, "la " * 40_000), (8, "one two three")]
    df = spark.createDataFrame([(*r, *MORE) for r in rows], "doc_id long, text string" + EXTRA).repartition(3)
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"], r["n_words"]) for r in periodic_runs.detect(df, collapsed=True).collect()}
    assert got == {
        1: ([], "", 0), 2: ([], "", 0), 3: ([], "", 0), 4: ([], "a a a a a", 5), 5: ([(0, 6, 1)], "a", 6), 6: ([(1, 18, 2)], "x b c y", 20), None: ([(0, 10, 2)], "é è", 10), 7: ([(0, 40_000, 1)], "la", 40_000), 8: ([], "one two three", 3),
    }
    assert periodic_runs.detect(df.filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_hard_negatives", "op13_periodic_runs"])
def test_queries_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    found = c.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_columns_of_any_name_stay(spark):
    rng = random.Random(1)
    words = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40))
    rows = [(i, words(), "en", "web", f"k{i}", i, "x", "y") for i in range(5)] + [(9, "short", "en", "web", "k9", 9, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __key string, row int, key string, c0 string")
    assert sorted(map(tuple, quality.keep_good(df).collect())) == rows[:5]
    assert sorted(map(tuple, simhash.keep_first(df).collect())) == sorted(map(tuple, df.collect()))
    again = df.union(df)
    assert sorted(map(tuple, simhash.keep_first(again).collect())) == sorted(map(tuple, df.collect()))


def test_a_text_of_very_many_lines(spark):
    """One text of 200,000 lines, of which some repeat and some are blank."""
    rng = random.Random(6)
    lines = [f"line number {i} of {rng.random()}" if i % 10 else "" for i in range(200_000)]
    for i in range(1, 200_000, 5000):
        lines[i] = lines[1]
    seen = set()
    want = [x for x in lines if x == "" or x not in seen and not seen.add(x)]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    kept = spark.createDataFrame([(1, [i for i, x in enumerate(lines) if x and (i == 1 or x != lines[1])])], "doc long, kept array<int>")
    original, line_dedup.kept_lines = line_dedup.kept_lines, lambda docs: docs.withColumn("of", line_dedup._text_hash()).join(kept, "doc").select("doc", "of", "kept")
    try:
        began = time.time()
        assert line_dedup.dedup_lines(df).first()["text"] == "\n".join(want)
        assert time.time() - began < 30
    finally:
        line_dedup.kept_lines = original
