"""Running values over the rows of a key in their order, also where one key holds very many rows.

A window by key is one task for each key. Here rows are dealt into ranges of key and order,
so that a large key spans several; each range is scanned by itself, and what a range begins
with comes from a scan over the ranges, of which there are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut

#: Rows of a key from which on it is dealt into ranges.
HOT = 2_000_000


def has_hot_key(rows: DataFrame, keys: list[str]) -> bool:
    return (rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > HOT


def in_ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``__part``, the number of the range of keys and order that they are in. Cut, since ranges are sampled anew where they run again."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(ranges, *keys, *order).withColumn("__part", F.spark_partition_id()))


def _with_ranges(dealt: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``dealt`` joined to what is known of each key in each range; unknown keys are alike."""
    r = ranges.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in ranges.columns if c not in ("__part", *keys)))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col("__part") == F.col("__p"))
    return dealt.join(r, same, "left").drop("__p", *(f"__k{i}" for i in range(len(keys))))


def neighbour(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, *, ahead: bool = False, own: bool = True, hot: bool | None = None) -> DataFrame:
    """``rows`` with ``name``: the last ``value`` that is known up to a row, in ``order``; with ``ahead`` the next one. ``own``
    tells whether the row's own value counts, ``hot`` whether a key is large, if that is known."""
    pick = F.first if ahead else F.last
    edge = 0 if own else 1
    frame = (edge, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -edge)
    if not (has_hot_key(rows, keys) if hot is None else hot):
        return rows.withColumn(name, pick(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)))
    dealt = in_ranges(rows, keys, order)
    local = dealt.withColumn("__local", pick(value, ignorenulls=True).over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(*frame)))
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = dealt.groupBy("__part", *keys).agg((F.min_by if ahead else F.max_by)(value, place).alias("__end"))
    others = (1, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carried", pick("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(*others))).drop("__end")
    both = _with_ranges(local, carried.filter("__carried is not null"), keys)
    return both.withColumn(name, F.coalesce("__local", "__carried")).drop("__local", "__carried", "__part")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, hot: bool | None = None) -> DataFrame:
    """``rows`` with ``name``, their number in their key from 0 on, in ``order``, which must tell all rows of a key apart."""
    if not (has_hot_key(rows, keys) if hot is None else hot):
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    dealt = in_ranges(rows, keys, order)
    local = dealt.withColumn("__local", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order)) - 1)
    sizes = dealt.groupBy("__part", *keys).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    both = _with_ranges(local, sizes.withColumn("__before", before).drop("__n"), keys)
    return both.withColumn(name, (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("int")).drop("__local", "__before", "__part")
