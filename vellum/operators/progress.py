"""Resume feeds over the latest state of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio_of
from .relational import top_per_group

# From which share an item counts as started and as finished, and after how many days it is forgotten.
STARTED, FINISHED, EXPIRY_DAYS = 0.05, 0.9, 182


def latest(states: DataFrame, keys: list[str], item: str) -> DataFrame:
    """The item last touched in each group; of equal times, the furthest."""
    return top_per_group(states, keys, [F.desc("updated"), F.desc(item)])


def next_item(states: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Where the last touched item is finished: the first later item that isn't.

    One grouping on the same keys, so that the join needs no further shuffle.
    """
    last = latest(states, keys, item).filter("watched").select(*keys, F.col(item).alias("__last"))
    later = states.join(last, keys).filter((F.col(item) > F.col("__last")) & ~F.col("watched"))
    return later.groupBy(*keys).agg(F.min_by(F.struct(F.col(item).alias("next"), "updated"), item).alias("n")).select(*keys, "n.next", "n.updated")


def feed_entries(states: DataFrame, keys: list[str], item: str, duration: float) -> DataFrame:
    """What to go on with in each group: an item begun, or the one after a finished one. ``touched`` is when the group was
    last watched, by which entries are forgotten."""
    ratio = ratio_of(F.col("position"), F.lit(duration))
    last = latest(states, keys, item)
    resume = last.filter(~F.col("watched") & (ratio >= STARTED) & (ratio < FINISHED)).select(*keys, item, F.lit("resume").alias("kind"), "updated", F.col("updated").alias("touched"))
    followed = next_item(states, keys, item).withColumnRenamed("next", item).join(last.select(*keys, F.col("updated").alias("touched")), keys)
    return resume.unionByName(followed.select(*keys, item, F.lit("next").alias("kind"), "updated", "touched"))


def fresh_entries(entries: DataFrame, now: str) -> DataFrame:
    """Entries that aren't forgotten at ``now``, which is given, so results repeat."""
    kind = entries.schema["touched"].dataType
    return entries.filter(F.col("touched") >= F.to_timestamp_ntz(F.lit(now)).cast(kind) - F.expr(f"INTERVAL {EXPIRY_DAYS} DAYS"))


def continue_feed(states: DataFrame, keys: list[str], item: str, duration: float, now: str) -> DataFrame:
    return fresh_entries(feed_entries(states, keys, item, duration), now).drop("touched")
