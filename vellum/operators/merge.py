"""Snapshots: differences, upserts with a policy for each column, soft deletes, queues.

Parquet tables can't be updated in place, so a merge is one full outer join on the key
and gives the whole new table. Keys must be unique on each side; :func:`latest_by` makes
them so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, that with the greatest ``order``, without a sort."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], prints: list[str]) -> DataFrame:
    """Per key: NEW, GONE, CHANGED or SAME, by the columns ``prints`` (unknown equals unknown)."""
    a = old.select(*keys, F.struct(*prints).alias("a"))
    b = new.select(*keys, F.struct(*prints).alias("b"))
    state = F.when(F.col("a").isNull(), "NEW").when(F.col("b").isNull(), "GONE").when(F.col("a").eqNullSafe(F.col("b")), "SAME").otherwise("CHANGED")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_known: list[str] = (), insert_only: bool = False) -> DataFrame:
    """``old`` with ``new`` merged in. Columns of ``keep_known`` take a new value only where it is known;
    with ``insert_only`` rows that are there stay as they are."""
    both = old.withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), keys, "full")
    there, given = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def value(c):
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if insert_only:
            return F.when(there, o).otherwise(n)
        return F.coalesce(n, o) if c in keep_known else F.when(given, n).otherwise(o)

    return both.select(*(F.col(k) if k in keys else value(k).alias(k) for k in old.columns))


def soft_delete(old: DataFrame, seen: DataFrame, keys: list[str], flag: str = "present") -> DataFrame:
    """``old`` with ``flag`` false for keys that the scan didn't see."""
    found = seen.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return old.drop(flag).join(found, keys, "left").withColumn(flag, F.coalesce("__seen", F.lit(False))).drop("__seen")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents that ``new`` has are replaced whole."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def enqueue(queue: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """A queue after targets were handed in: unknown ones are added, those with another fingerprint wake up.

    ``queue``: keys, ``status``, ``attempts``, ``fingerprint``. ``outcome`` tells what was done.
    """
    t = targets.select(*keys, F.col("fingerprint").alias("__new"), F.lit(True).alias("__given"))
    both = queue.withColumn("__old", F.lit(True)).join(t, keys, "full")
    outcome = F.when(F.col("__old").isNull(), "added").when(F.col("__given").isNull(), "untouched").when(F.col("fingerprint").eqNullSafe(F.col("__new")), "unchanged").otherwise("reactivated")
    fresh = F.col("outcome").isin("added", "reactivated")
    return both.withColumn("outcome", outcome).select(
        *keys, F.when(fresh, "pending").otherwise(F.col("status")).alias("status"), F.when(fresh, 0).otherwise(F.col("attempts")).alias("attempts"),
        F.when(fresh, F.col("__new")).otherwise(F.col("fingerprint")).alias("fingerprint"), "outcome",
    )


def transition(queue: DataFrame, action: str) -> DataFrame:
    """Bulk transitions of a queue's rows: requeue stale or failed work, which keeps its attempts, or all, which loses them."""
    status = F.col("status")
    hit = {"requeue_stale": status == "running", "requeue_failed": status == "failed", "requeue_all": F.lit(True)}[action]
    fresh = F.lit(0).cast(dict(queue.dtypes)["attempts"])
    attempts = fresh if action == "requeue_all" else F.col("attempts")
    return queue.withColumns({"status": F.when(hit, "pending").otherwise(status), "attempts": attempts})


def find_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """A dimension with rows for all ``wanted`` keys; new ids follow the greatest there is, in order of the keys.

    New keys are numbered by ranges: their counts by partition come first, so no single task sees them all.
    """
    fresh = wanted.select(*keys).distinct().join(existing, keys, "left_anti")
    from pyspark.sql import Window

    # the ranges of a sort are sampled anew where it runs again: they are kept for both uses
    ordered = cut(fresh.sort(*keys).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))

    local = F.row_number().over(Window.partitionBy("__part").orderBy("__row"))
    numbered = ordered.withColumn("__n", local)
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("__before", before).select("__part", "__before")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top")).withColumn("__one", F.lit(1))
    made = numbered.join(offsets, "__part").withColumn("__one", F.lit(1)).join(F.broadcast(top), "__one")
    return existing.select(*keys, id_col).unionByName(made.select(*keys, (F.col("__top") + F.col("__before") + F.col("__n")).alias(id_col)))
