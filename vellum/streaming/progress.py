"""Progress reports as a stream: latest state by key, throttling, expiry, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import latest_by

KEYS = ["user_id", "item"]


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def merge_states(old: DataFrame | None, batch: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """States after a batch: the latest report of each key, whatever order reports come in. A position past the end counts as seen."""
    seen = F.col("value") >= 90.0
    new = latest_by(batch, keys, "ts").select(*keys, "ts", F.when(seen, 0.0).otherwise(F.col("value")).alias("position"), seen.alias("watched"))
    return new if old is None else latest_by(old.unionByName(new), keys, "ts")


def throttled(events: DataFrame, seconds: float = 10.0, least: float = 5.0) -> DataFrame:
    """Reports that moved by ``least`` and come ``seconds`` after the last one let through, by user; state expires with the watermark."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples():
            at = row.ts.timestamp()
            if last is None or (at - last[0] >= seconds and abs(row.value - last[1]) >= least):
                last = (at, float(row.value))
                out.append((key[0], row.event_id, row.ts, row.value))
        if last is not None:
            state.update(last)
            state.setTimeoutTimestamp(int(max(last[0] * 1000, state.getCurrentWatermarkMs())) + 86_400_000)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts", "value"])

    return events.withWatermark("ts", "1 day").groupBy("user_id").applyInPandasWithState(
        run, "user_id long, event_id long, ts timestamp, value double", "at double, value double", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Reports by type in windows of event time; a window closes ``late`` after its end."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
