"""Upkeep of tables: work queues, cascades, dimensions, manual decisions and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim(queue: DataFrame, limit: int, order: list) -> DataFrame:
    """The queue after the first ``limit`` pending rows in ``order`` were taken: ``running``, with an attempt more.
    ``claimed`` tells which."""
    first = queue.filter("status = 'pending'").orderBy(*order, "id").limit(limit).select("id", F.lit(True).alias("__mine"))
    both = queue.join(F.broadcast(first), "id", "left")
    mine = F.coalesce("__mine", F.lit(False))
    return both.select("id", F.when(mine, "running").otherwise(F.col("status")).alias("status"), (F.col("attempts") + F.when(mine, 1).otherwise(0)).alias("attempts"), *(c for c in queue.columns if c not in ("id", "status", "attempts")), mine.alias("claimed"))


def settle(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after ``results`` (``id``, ``action``, ``reason``), one an id: complete, skip, fail, or requeue (which
    was no attempt). ``error`` is the reason of a skip or failure."""
    both = queue.join(results.select("id", F.col("action").alias("__action"), F.col("reason").alias("__reason")), "id", "left")
    action = F.col("__action")
    status = F.when(action == "complete", "done").when(action == "skip", "skipped").when(action == "fail", "failed").when(action == "requeue", "pending").otherwise(F.col("status"))
    attempts = F.when(action == "requeue", F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts"))
    error = F.when(action.isin("skip", "fail"), F.col("__reason")).when(action == "complete", F.lit(None)).otherwise(F.col("error"))
    changed = {"status": status, "attempts": attempts.cast(dict(queue.dtypes)["attempts"]), "error": error}
    return both.select(*(changed.get(c, F.col(c)).alias(c) for c in queue.columns))


def place_in_queue(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """Each row with its place in its ordered queue (from 1) and how many there are."""
    return rows.withColumns({"place": F.row_number().over(Window.partitionBy(*group).orderBy(*order)), "total": F.count("*").over(Window.partitionBy(*group))})


def cascade(gone: DataFrame, key: str, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each table (with its column of the key) without the rows of keys that are ``gone``."""
    keys = gone.select(F.col(key).alias("__gone")).distinct()
    return {name: df.join(keys, F.col(column) == F.col("__gone"), "left_anti") for name, (df, column) in tables.items()}


def sync_dimension(old: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The dimension as it is wanted: known rows keep what ``wanted`` doesn't have, unwanted rows go, new ones come."""
    extra = [c for c in old.columns if c not in wanted.columns]
    return wanted.join(old.select(key, *extra), key, "left").select(*old.columns)


def keep_manual(old: DataFrame, found: DataFrame, key: str, manual: Column, columns: list[str]) -> DataFrame:
    """``old`` with what an automatic pass ``found``, but where a person decided."""
    both = old.alias("o").join(found.alias("n"), key, "left")
    given = F.col(f"n.{columns[0]}").isNotNull() & ~F.coalesce(manual, F.lit(False))
    return both.select(*(F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in columns else F.col(c if c == key else f"o.{c}").alias(c) for c in old.columns))


def reset_outdated(rows: DataFrame, version: Column, current: str) -> DataFrame:
    """Rows made by another version lose their result and wait again; ``reset`` tells which."""
    outdated = (F.col("status") == "done") & ~version.eqNullSafe(F.lit(current))
    return rows.withColumns({"status": F.when(outdated, "pending").otherwise(F.col("status")), "attempts": F.when(outdated, 0).otherwise(F.col("attempts")), "reset": outdated})


def changed_or_unparsed(old: DataFrame, scan: DataFrame, key: str, prints: list[str], parsed: str) -> DataFrame:
    """Rows of a scan that are to be read again: new, changed, or never parsed."""
    known = old.select(key, F.struct(*prints).alias("__old"), F.col(parsed).alias("__parsed"))
    both = scan.join(known, key, "left")
    why = F.when(F.col("__old").isNull(), "new").when(~F.coalesce("__parsed", F.lit(False)), "unparsed").when(~F.struct(*prints).eqNullSafe(F.col("__old")), "changed")
    return both.withColumn("why", why).filter("why is not null").select(*scan.columns, "why")


def latest_state(events: DataFrame, keys: list[str], order: list[str], removed: Column) -> DataFrame:
    """The last event of each key; keys of which the last event removes the state have none."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("__r")).select("__r.*").filter(~removed)


def with_columns_of(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """``df`` with columns that it doesn't have yet, of unknown values, in the order of ``schema``."""
    return df.select(*(F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in schema.items()))


def backfill(df: DataFrame, version: str, to: int, values: dict[str, Column]) -> DataFrame:
    """Unknown values of rows below version ``to`` filled once; other rows are left as they are."""
    old = F.coalesce(F.col(version), F.lit(0)) < to
    filled = {c: F.when(old, F.coalesce(F.col(c), x)).otherwise(F.col(c)) for c, x in values.items()}
    return df.withColumns(filled | {version: F.when(old, to).otherwise(F.col(version))})
