"""Every query with an SQL twin against DuckDB on the same tables."""

import math

import duckdb
import pytest

from vellum.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_customers_that_look_like_years(spark, tmp_path):
    keys = [7, 1887, 1888, 1900, 1901, 1999, 20000]
    spark.createDataFrame(list(enumerate(keys, 1)), "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: r["show"] for r in QUERIES["episode_marker"](spark, str(tmp_path)).collect()}
    assert got == {i: f"Customer {k}" for i, k in enumerate(keys, 1)}


@pytest.mark.parametrize("name,key", [("glued_words", "p_partkey"), ("noise_cut", "p_partkey"), ("episode_marker", "o_orderkey")])
def test_names_are_dealt_over_all_tasks(spark, name, key):
    assert f"RepartitionByExpression [{key}#" in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_more_rows_make_more_tasks(spark, monkeypatch):
    from vellum.operators import relational

    monkeypatch.setattr(relational, "TASK_ROWS", 10)
    assert [relational.by_groups(spark.range(n), "id").rdd.getNumPartitions() for n in (0, 10, 95)] == [1, 1, 10]
    rows = QUERIES["duplicates_across_roots"](spark, SF)
    assert rows.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 10)


def test_tied_lines_stay_in_order(spark, tmp_path):
    lines = [(1, 1, 5, "R"), (1, 1, 5, "N"), (2, 1, 5, "N"), (2, 1, 5, "R"), (3, 2, 5, "A"), (3, 1, 9, "N"), (3, 1, 9, "A"), (3, 1, 9, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, QUERIES["leading_run"](spark, str(tmp_path)).collect()))
    one = duckdb.connect()
    one.execute("set threads = 1")
    one.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(one.execute(SQL["leading_run"]).fetchall()) == [(1, 0), (2, 1), (3, 1)]
