"""Intervals over sorted points: tilings, greedy segments, as-of and nearest lookups, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from . import fold, scans


def rounded(x: Column) -> Column:
    """To thousandths, halves up."""
    return F.floor(x * 1000 + 0.5) / 1000


def tiling(duration: Column, head: int = 3, short: float = 2.0, step: float = 4.0) -> Column:
    """Fixed steps after ``head`` short ones, the last cut to the duration: array of (index, start, duration)."""
    lead = head * short
    n = F.when(duration <= lead, F.ceil((duration - 0.001) / short)).otherwise(head + F.ceil((duration - lead - 0.001) / step))
    start = lambda i: F.when(i <= head, i * short).otherwise(lead + (i - head) * step)
    width = lambda i: F.when(i < head, F.lit(short)).otherwise(F.lit(step))
    tile = lambda i: F.struct(i.cast("int").alias("index"), rounded(start(i)).alias("start"), rounded(F.least(width(i), duration - start(i))).alias("duration"))
    return F.when(duration > 0.001, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), tile))


def tiling_merged_tail(duration: Column, step: float = 8.0, least: float = 1.0) -> Column:
    """Fixed steps; a tail shorter than ``least`` goes to the step before."""
    n = F.ceil((duration - 0.001) / step)
    tail = duration - (n - 1) * step
    kept = F.when((n > 1) & (rounded(tail) < least), n - 1).otherwise(n)
    end = lambda i: F.when(i == kept - 1, duration).otherwise((i + 1) * step)
    tile = lambda i: F.struct(i.cast("int").alias("index"), rounded(i * step).alias("start"), rounded(end(i) - i * step).alias("duration"))
    return F.when(duration > 0.001, F.transform(F.sequence(F.lit(0).cast("long"), kept - 1), tile))


def _following(points: DataFrame, key: str, time: str, target: float) -> DataFrame:
    """Per distinct time of a key, ``next``: the first one that is ``target`` or more later.

    Times ask for their successor in the order of all times. Sums and differences of times are rounded apart, so each
    asks a little early, and takes the one after what it finds where that is too near.
    """
    nodes = scans.neighbour(points, [key], [time], time, "__after", ahead=True, own=False, hot=True)
    early = (F.col(time) + target) - (F.abs(F.col(time)) + target) * 2.0**-52
    asks = nodes.select(key, early.alias("__at"), F.lit(0).alias("__side"), F.col(time).alias("__t"), F.lit(None).cast("struct<t:double,after:double>").alias("__found"))
    there = nodes.select(key, F.col(time).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("double").alias("__t"), F.struct(F.col(time).alias("t"), F.col("__after").alias("after")).alias("__found"))
    met = scans.neighbour(asks.unionByName(there), [key], ["__at", "__side"], "__found", "__hit", ahead=True, hot=True).filter("__side = 0")
    near = F.col("__hit.t") - F.col("__t") >= target
    return met.select(key, F.col("__t").alias(time), F.when(near, F.col("__hit.t")).otherwise(F.col("__hit.after")).alias("next"))


def _starts_by_doubling(points: DataFrame, key: str, time: str, target: float) -> DataFrame:
    """The times at which segments open: what can be reached from the first time by steps to the next opening.

    Each round doubles the steps that are known and the part that is reached, so a key of n segments takes log2(n)
    joins on key and time, on which no key is large.
    """
    steps = cut(_following(points, key, time, target).filter("next is not null"))
    reached = points.groupBy(key).agg(F.min(time).alias(time))
    while not steps.isEmpty():
        found = reached.join(steps, [key, time]).select(key, F.col("next").alias(time))
        reached = cut(reached.unionByName(found))
        onward = steps.select(key, F.col(time).alias("next"), F.col("next").alias("__then"))
        steps = cut(steps.join(onward, [key, "next"]).select(key, time, F.col("__then").alias("next")))
    return reached


def greedy_segments(points: DataFrame, key: str, time: str, end: Column, target: float) -> DataFrame:
    """Per key, the greedy segments over its points: ``index``, ``start``, ``duration``. A segment opens at the first point, and at
    each that is ``target`` or more after the last opening. ``end`` is an aggregate: where the last segment of a key ends."""
    times = points.select(key, F.col(time).cast("double").alias(time)).filter(F.col(time).isNotNull()).distinct()
    hot = scans.has_hot_key(times, [key])
    if hot:
        starts = _starts_by_doubling(cut(times), key, time, target)
    else:
        starts = fold.keep_by_fold(times, key, [time], [time], lambda last, now: (now[0], True) if last is None or now[0] - last >= target else (last, False))
    order = scans.neighbour(scans.numbered(starts, [key], [time], "index", hot), [key], [time], time, "__stop", ahead=True, own=False, hot=hot)
    ends = points.filter(F.col(time).isNotNull()).groupBy(key).agg(end.alias("__end"))
    stop = F.coalesce("__stop", "__end")
    return order.join(ends, key).select(key, "index", rounded(F.col(time)).alias("start"), rounded(F.greatest(F.lit(0.0), stop - F.col(time))).alias("duration"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """``left`` with the value of the last row of ``right`` at or before its time.

    Both are put in one order: no pair of rows is ever formed.
    """
    a = left.withColumns({"__side": F.lit(1), "__value": F.expr(f"cast(null as {dict(right.dtypes)[value]})")})
    b = right.select(*keys, time, F.col(value).alias("__value"), F.lit(0).alias("__side"))
    both = scans.neighbour(a.unionByName(b, allowMissingColumns=True), keys, [time, "__side"], "__value", value)
    return both.filter("__side = 1").drop("__side", "__value")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str) -> DataFrame:
    """``left`` with ``nearest``, the closest time of ``right``; of two as close, the earlier."""
    a = left.withColumns({"__side": F.lit(1), "__at": F.expr(f"cast(null as {dict(right.dtypes)[time]})")})
    b = right.select(*keys, time, F.col(time).alias("__at"), F.lit(0).alias("__side"))
    rows = a.unionByName(b, allowMissingColumns=True)
    hot = scans.has_hot_key(rows, keys)
    both = scans.neighbour(rows, keys, [time, "__side"], "__at", "__b", hot=hot)
    found = scans.neighbour(both, keys, [time, "__side"], "__at", "__a", ahead=True, hot=hot).filter("__side = 1")
    closer = F.when(F.col("__b").isNull(), F.col("__a")).when(F.col("__a").isNull(), F.col("__b")).when(F.col(time) - F.col("__b") <= F.col("__a") - F.col(time), F.col("__b")).otherwise(F.col("__a"))
    return found.withColumn("nearest", closer).drop("__side", "__at", "__a", "__b")


def to_next(rows: DataFrame, keys: list[str], order: list[str], time: str, name: str) -> DataFrame:
    """``rows`` with ``name``, how long it is to the next row of their key; null for the last."""
    return scans.neighbour(rows, keys, order, time, "__next", ahead=True, own=False).withColumn(name, F.col("__next") - F.col(time)).drop("__next")


def first_gap(present: DataFrame, key: str, index: str) -> DataFrame:
    """Per key, the first whole number from 0 on that isn't there, with no range generated: the place where order and value part.
    Negative and unknown numbers count for nothing, but their key does."""
    w = Window.partitionBy(key).orderBy(index)
    ranked = present.select(key, F.when(F.col(index) >= 0, F.col(index)).alias(index)).distinct()
    ranked = ranked.withColumn("__r", F.row_number().over(w) - F.when(F.count_if(F.col(index).isNull()).over(Window.partitionBy(key)) > 0, 2).otherwise(1))
    return ranked.groupBy(key).agg(F.count_if(F.col(index) == F.col("__r")).alias("first_gap"))
