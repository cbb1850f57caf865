"""Deep pages: rows in ranges of their order, so that a page far behind costs what the first one does.

``offset`` and ``limit`` carry all rows before a page to one task. Here rows are put into
ranges once, and how many each range holds is known; a page reads the ranges it lies in.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut


class Pages:
    """``rows`` in an order (columns, with their direction), whose last key must tell all rows apart."""

    def __init__(self, rows: DataFrame, order: list, ranges: int | None = None):
        self.order, self.columns = order, rows.columns
        n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = cut(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
        sizes = sorted((r["__range"], r["n"]) for r in self.rows.groupBy("__range").agg(F.count("*").alias("n")).collect())
        self.ranges, self.starts = [r for r, _ in sizes], [0, *accumulate(n for _, n in sizes)]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def count(self, size: int) -> int:
        """How many pages there are: one at least."""
        return max(1, -(-self.total // size))

    def page(self, number: int, size: int) -> DataFrame:
        """A page (from 1), in order. Only the ranges it lies in are read and sorted."""
        first, last = (number - 1) * size, min(number * size, self.total)
        if first >= last:
            return self.rows.filter(F.lit(False)).select(*self.columns)
        a, b = bisect_right(self.starts, first) - 1, bisect_right(self.starts, last - 1)
        mine = self.rows.filter(F.col("__range").isin(self.ranges[a:b]))
        return mine.orderBy(*self.order).offset(first - self.starts[a]).limit(last - first).select(*self.columns)
