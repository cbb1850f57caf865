"""Joins, pages, rankings and counts that queries share."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task aims at where groups are brought together ahead of an aggregation.
TASK_ROWS = 1 << 18


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by key over all tasks, ahead of much work on each: a small file would be worked off by one task alone."""
    return rows.repartition(key)


def by_groups(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` brought together by key in tasks of about :data:`TASK_ROWS`: more rows make more tasks, not larger ones, and
    aggregates by these keys take the memory of one."""
    return rows.repartition(max(1, ceil(rows.count() / TASK_ROWS)), *keys)


def semi(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` with a match."""
    return left.join(right, on, "left_semi")


def exists_flag(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """``left`` with a column that tells whether there is a match."""
    return left.join(right.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def join_given(left: DataFrame, right: DataFrame, on: list[str], given: dict[str, object]) -> DataFrame:
    """Left outer join whose condition also has parameters: ``given`` holds columns of ``right`` with the value they must have.
    They select before the join, so rows of ``left`` without such a match stay, and less is moved."""
    mine = right
    for column, value in given.items():
        mine = mine.filter(F.col(column) == F.lit(value))
    return left.join(mine.drop(*given), on, "left")


def one_but_not_other(rows: DataFrame, there: DataFrame, absent: DataFrame, on: list[str], name: str) -> DataFrame:
    """``rows`` with a column that tells whether they have a match in ``there`` and none in ``absent``."""
    held = there.select(*on).distinct().join(absent.select(*on).distinct(), on, "left_anti").withColumn(name, F.lit(True))
    return rows.join(held, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def gated(rows: DataFrame, shown: Column, available: Column, searching: bool) -> DataFrame:
    """What a list shows: browsing leaves out what is not available, a search only what is never shown."""
    return rows.filter(shown if searching else shown & available)


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page (from 1); the last key must be unique for pages not to overlap."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def top_per_group(rows: DataFrame, keys: list[str], order: list, k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; ``rank`` keeps their number."""
    name = rank or "__rank"
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def distribution(rows: DataFrame, value: Column, unknown: str = "(unknown)") -> DataFrame:
    """Counts of a value, the unknown by a name, and percent of all rows."""
    counts = rows.groupBy(F.coalesce(value.cast("string"), F.lit(unknown)).alias("value")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", percent(F.col("n"), total))


def percent(part: Column, whole: Column) -> Column:
    """Percent with one decimal, halves up; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(1000.0 * part / whole + 0.5) / 10)


def first_in_source(rows: DataFrame, keys: list[str], items: str, item: str, fields: list[str], wanted: Column | None = None) -> DataFrame:
    """Items of each row's array in the order they are listed in, only the first of each ``item``, and of those that are ``wanted``;
    ``place`` counts from 1. Arrays are handled row by row: nothing is shuffled."""
    listed = F.filter(items, lambda x: x[item].isNotNull() if wanted is None else x[item].isNotNull() & F.coalesce(wanted(x), F.lit(False)))
    first = F.filter(listed, lambda x, i: F.array_position(F.transform(listed, lambda y: y[item]), x[item]) == i + 1)
    return rows.select(*keys, F.posexplode(first).alias("__at", "__x")).select(*keys, (F.col("__at") + 1).alias("place"), *(F.col(f"__x.{c}").alias(c) for c in fields))


def recent_rates(samples: DataFrame, targets: DataFrame, key: str, order: list[str], value: str, name: str, last: int = 5) -> DataFrame:
    """``targets`` with the mean of the ``last`` values of their key; where it has none, the mean of these values of all keys."""
    kept = top_per_group(samples.filter(F.col(value).isNotNull()), [key], [F.desc(c) for c in order], last)
    own = kept.groupBy(key).agg(F.avg(value).alias("__own"), F.sum(value).alias("__sum"), F.count("*").alias("__n"))
    every = own.agg((F.sum("__sum") / F.sum("__n")).alias("__all")).withColumn("__one", F.lit(1))
    rows = targets.join(own.select(key, "__own"), key, "left").withColumn("__one", F.lit(1)).join(F.broadcast(every), "__one")
    return rows.withColumn(name, F.coalesce("__own", "__all")).drop("__one", "__own", "__all")


def newest_failures(jobs: DataFrame, files: DataFrame, key: str, newest: list, limit: int = 20, unknown: str = "unknown cause") -> DataFrame:
    """The last failed jobs with the file each was about; of the jobs only the newest ``limit`` with a file are moved."""
    failed = jobs.filter("status = 'failed'").join(files, key)
    return failed.withColumn("error", F.coalesce("error", F.lit(unknown))).orderBy(*newest).limit(limit)


def dedup_keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_per_group(rows, keys, order, 1)


def pivot_counts(rows: DataFrame, column: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Counts of fixed values as columns, and their total, in one pass."""
    aggs = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return (rows.groupBy(*by) if by else rows).agg(*aggs, F.count("*").alias("total"))
