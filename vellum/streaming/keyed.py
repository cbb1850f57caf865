"""Tables that a stream keeps up to date, of which a batch rewrites only the parts it touches.

Rows are dealt into a fixed number of buckets by a hash of some columns. A batch writes new
versions of the buckets that its keys fall into, and then a manifest that names the version
of each bucket; readers see the old state until the manifest is complete. A batch that is
run again starts from the manifest before its own and writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.progress import feed_entries, fresh_entries
from ..scratch import cut
from .progress import KEYS, merge_states


class KeyedTable:
    """A table below ``path``: ``data/v=N/b=K`` is bucket K as batch N left it, ``manifest/v=N`` which versions count after N."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: list[str], buckets: int = 64):
        self.spark, self.path, self.by, self.buckets = spark, path.rstrip("/"), by, buckets
        self.empty = spark.createDataFrame([], schema)

    def bucket(self):
        return F.pmod(F.hash(*self.by), F.lit(self.buckets))

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Batches whose manifest is complete."""
        at, files = self._files(f"{self.path}/manifest")
        if not files.exists(at):
            return []
        names = [x.getPath().getName() for x in files.listStatus(at)]
        done = lambda n: files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{n}/_SUCCESS"))
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and done(n))

    def manifest(self, number: int | None = None) -> dict[int, int]:
        """Version by bucket after batch ``number``, or after the last one."""
        known = self.versions()
        last = max((v for v in known if number is None or v <= number), default=None)
        if last is None:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.path}/manifest/v={last}").collect()}

    def _rows(self, manifest: dict[int, int], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/v={v}/b={b}" for b, v in sorted(manifest.items()) if only is None or b in only]
        return self.spark.read.schema(self.empty.schema).parquet(*paths) if paths else self.empty

    def read(self, number: int | None = None) -> DataFrame:
        """The table after batch ``number``, or after the last one."""
        return self._rows(self.manifest(number))

    def touched(self, rows: DataFrame) -> set[int]:
        """Buckets of these rows, of which there are as many as the table has at most."""
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def update(self, number: int, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> set[int]:
        """Let batch ``number`` rewrite the buckets it touches: ``merge(old rows of these buckets, batch)`` gives their new rows."""
        before = self.manifest(number - 1)
        mine = self.touched(batch)
        if mine:
            new = merge(self._rows(before, mine), batch).select(*self.empty.columns).withColumn("b", self.bucket())
            new.repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{self.path}/data/v={number}")
            at, files = self._files(f"{self.path}/data/v={number}")
            written = {int(x.getPath().getName()[2:]) for x in files.listStatus(at) if x.getPath().getName().startswith("b=")}
        else:
            written = set()
        now = {b: v for b, v in before.items() if b not in mine} | {b: number for b in written}
        rows = self.spark.createDataFrame(sorted(now.items()), "bucket int, version int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={number}")
        return mine

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete versions that none of the last ``keep`` manifests names; those deleted."""
        known = self.versions()
        held = {v for n in known[-keep:] for v in self.manifest(n).values()}
        at, files = self._files(f"{self.path}/data")
        there = [int(x.getPath().getName()[2:]) for x in files.listStatus(at)] if files.exists(at) else []
        gone = sorted(v for v in there if v not in held and v <= (known[-1] if known else -1))
        for v in gone:
            files.delete(self._files(f"{self.path}/data/v={v}")[0], True)
        for n in known[:-keep]:
            files.delete(self._files(f"{self.path}/manifest/v={n}")[0], True)
        return gone


STATES = "user_id long, series string, item long, ts timestamp_ntz, position double, watched boolean"
FEED = "user_id long, series string, item long, kind string, updated timestamp_ntz, touched timestamp_ntz"
GROUP = ["user_id", "series"]


class ResumeFeed:
    """States of progress by user, series and item, and the resume feed that follows from them, kept up by batches of reports.

    Reports have ``user_id``, ``series``, ``item``, ``ts`` and ``value``. A batch recomputes the feed of those users and series
    that it touches, from the buckets that hold them. What is too old is left out where the feed is read, so time passes
    without a batch.
    """

    def __init__(self, spark: SparkSession, path: str, duration: float = 100.0, buckets: int = 64):
        self.duration = duration
        self.states = KeyedTable(spark, f"{path}/states", STATES, GROUP, buckets)
        self.feed = KeyedTable(spark, f"{path}/feed", FEED, GROUP, buckets)

    def take(self, batch: DataFrame, number: int) -> None:
        """Take in batch ``number``; may be run again."""
        batch = cut(batch.select("user_id", "series", "item", "ts", "value"))
        mine = self.states.update(number, batch, lambda old, new: merge_states(old, new, [*GROUP, "item"]))
        groups = batch.select(*GROUP).distinct()
        own = self.states._rows(self.states.manifest(number), mine).join(groups, GROUP, "left_semi")
        entries = feed_entries(own.withColumnRenamed("ts", "updated"), GROUP, "item", self.duration)
        self.feed.update(number, groups, lambda old, new: old.join(new, GROUP, "left_anti").unionByName(entries.select(*old.columns)))

    def entries(self, now: str) -> DataFrame:
        """The feed as it is at ``now``."""
        return fresh_entries(self.feed.read(), now)

    def follow(self, events: DataFrame, checkpoint: str, every: str | None = None):
        """Keep the feed up with a stream: ``every`` is the time between batches; without it what is there is taken in, and that is all."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return events.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def states_table(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, path, "user_id long, item long, ts timestamp_ntz, position double, watched boolean", KEYS, buckets)


def upsert_stream(events: DataFrame, path: str, checkpoint: str, every: str | None = None, buckets: int = 64):
    """Keep the latest state of each user and item below ``path``; a batch rewrites only the buckets of its keys.

    The table is read by :func:`states_table`. ``every`` is the time between batches; without it what is there is taken in, and that is all.
    """
    table = states_table(events.sparkSession, path, buckets)

    def run(batch: DataFrame, number: int) -> None:
        table.update(number, batch, merge_states)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()
