"""Paths under another root: a mapping table of roots, the most specific one that fits, and a check of the rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfc


def to_posix(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(.)/+$", "$1")


def comparable(path: Column) -> Column:
    """Paths that differ in case, separators or how accents are composed are alike."""
    return F.regexp_replace(F.regexp_replace(F.lower(nfc(path)), r"[\\/]+", "/"), "/+$", "")


def mapping_fault(source: Column, target: Column) -> Column:
    """Why a mapping can't be used; null if it can."""
    return F.when(F.trim(source) == "", "no source").when(F.trim(target) == "", "no target").when(~target.startswith("/"), "the target is not absolute")


def parse_mapping(argument: Column) -> Column:
    """``source=>target`` as a struct; null if one of them is missing."""
    source, target = (F.trim(F.regexp_extract(argument, "(?s)^(.*?)=>(.*)$", g)) for g in (1, 2))
    return F.when((source != "") & (target != ""), F.struct(source.alias("source"), target.alias("target")))


def remap(rows: DataFrame, mappings: DataFrame, path: str, out: str = "new_path") -> DataFrame:
    """``rows`` with the path under its new root; null where no mapping (``source``, ``target``) fits.

    A mapping fits whole segments; of those that fit, the longest counts. Each path asks for its own prefixes, so the
    join is on equal prefixes and its rows are as many as paths have segments.
    """
    segments = F.split(F.col("__like"), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(segments, F.lit(1), n), "/").alias("prefix")))
    own = rows.select(path).distinct().withColumn("__like", comparable(F.col(path)))
    asked = own.select(path, F.explode(ends).alias("__e")).select(path, F.col("__e.prefix").alias("__prefix"))
    # of mappings that are alike, the first by name
    known = mappings.withColumn("__prefix", comparable(F.col("source"))).filter("__prefix <> ''").groupBy("__prefix").agg(F.min(F.struct("source", "target")).alias("__m"))
    best = asked.join(known, "__prefix").groupBy(path).agg(F.max_by("__m", F.length("__prefix")).alias("__m"))
    given = F.split(F.regexp_replace("__m.source", r"[\\/]+$", ""), r"[\\/]")
    rest = F.filter(F.slice(F.split(F.col(path), r"[\\/]"), F.size(given) + 1, F.greatest(F.size(F.split(F.col(path), r"[\\/]")), F.lit(1))), lambda s: s != "")
    base = to_posix(F.col("__m.target"))
    new = F.when(F.size(rest) == 0, base).otherwise(F.concat(base, F.lit("/"), F.array_join(rest, "/")))
    return rows.join(best.select(path, new.alias(out)), path, "left").select(*rows.columns, out)


def rewrite_report(remapped: DataFrame, path: str, out: str = "new_path") -> DataFrame:
    """One row: how many paths are rewritten, left alone, and rewritten to a path that another row has too."""
    clash = remapped.filter(F.col(out).isNotNull()).groupBy(out).agg(F.countDistinct(path).alias("n")).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("clashes"))
    counts = remapped.agg(F.count(out).alias("rewritten"), F.count_if(F.col(out).isNull()).alias("untouched"))
    return counts.crossJoin(F.broadcast(clash))


def rewritten(remapped: DataFrame, path: str, out: str = "new_path") -> DataFrame:
    """The table with new paths, and old ones where there is no new one."""
    return remapped.withColumn(path, F.coalesce(out, path)).drop(out)
