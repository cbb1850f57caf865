"""Sources: file listings, JSON and line documents, schemas that grow."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import path_key, path_segments, split_extension
from ..scratch import cut

# What counts as a video or a subtitle, which names and folders are passed over, and the least size of a video.
VIDEO = [".mkv", ".mp4", ".avi", ".m4v", ".mov", ".wmv", ".ts", ".webm"]
SUBTITLE = [".srt", ".ass", ".ssa", ".vtt", ".sub"]
IGNORED_NAMES = ["desktop.ini", "thumbs.db", ".ds_store"]
IGNORED_FOLDERS = ["@eadir", "#recycle", "$recycle.bin", "system volume information", "lost+found"]
SIDE_WORDS = ["sample", "trailer", "featurette", "extras", "bonus"]
LEAST_BYTES = 50 * 1024 * 1024


def walk(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``: ``path``, ``size``, ``modified``. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def side_content(name: Column) -> Column:
    """Whether a name has a whole word that marks samples, trailers and the like."""
    return F.coalesce(name.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(SIDE_WORDS)})(?![\p{{L}}\p{{N}}])"), F.lit(False))


def classify(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """``files`` with ``kind`` (video, subtitle or null) and, where it is null, ``skipped``: why."""
    segments = path_segments(F.col(path))
    name, folders = F.element_at(segments, -1), F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    extension = split_extension(name)["extension"]
    pruned = F.exists(folders, lambda x: F.lower(x).isin(IGNORED_FOLDERS) | (x.startswith(".") & ~x.isin(".", "..")) | side_content(x))
    reason = (
        F.when(pruned, "folder").when(F.lower(name).isin(IGNORED_NAMES) | name.startswith("."), "name").when(extension.isin(SUBTITLE), F.lit(None)).when(~extension.isin(VIDEO), "extension")
        .when(side_content(name), "side content").when(F.col(size) < LEAST_BYTES, "too small")
    )
    kind = F.when(reason.isNull(), F.when(extension.isin(SUBTITLE), "subtitle").otherwise("video"))
    return files.select("*", kind.alias("kind"), reason.alias("skipped"))


def reachable(spark: SparkSession, root: str) -> bool:
    """Whether a root can be listed; a merge must not mark files of one that can't as gone."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    try:
        return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))
    except Exception:  # noqa: BLE001  an unreachable store raises whatever its client does
        return False


def json_documents(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows whose document parses, with its fields; the rest by :func:`broken_documents`."""
    parsed = rows.withColumn("__doc", F.from_json(column, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    return parsed.filter(F.col("__doc").isNotNull() & F.col("__doc._broken").isNull()).select(*rows.columns, "__doc.*").drop("_broken")


def broken_documents(rows: DataFrame, column: str, schema: str) -> DataFrame:
    parsed = rows.withColumn("__doc", F.from_json(column, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    return parsed.filter(F.col("__doc").isNull() | F.col("__doc._broken").isNotNull()).select(*rows.columns)


def ready_streams(files: DataFrame, path: str = "path") -> DataFrame:
    """Per folder of a listing: ``streams``, the numbers N of its files ``N.vtt``, ascending."""
    found = files.select(F.regexp_extract(path, r"^(.*)/(\d+)\.vtt$", 1).alias("folder"), F.regexp_extract(path, r"^(.*)/(\d+)\.vtt$", 2).alias("n")).filter("n <> ''")
    return found.groupBy("folder").agg(F.array_sort(F.collect_set(F.col("n").cast("int"))).alias("streams"))


def configured_roots(rows: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """The roots of JSON settings (``roots``: ``path``, ``kind``), of each setting (by ``keys``) the first of those whose paths
    are alike; roots without a path, or of an unknown kind, are left out."""
    keys = keys or []
    listed = rows.select(*keys, F.posexplode(F.from_json(column, "roots array<struct<path:string,kind:string>>")["roots"]).alias("at", "r"))
    known = listed.select(*keys, "at", F.trim("r.path").alias("path"), F.col("r.kind").alias("kind")).filter("path <> '' and kind in ('movie', 'show')")
    return known.groupBy(*keys, path_key(F.col("path")).alias("key")).agg(F.min(F.struct("at", "path", "kind")).alias("r")).select(*keys, "r.path", "r.kind")


def point_times(lines: Column) -> Column:
    """Times of ``time,flags`` lines whose flags have a K: not negative, sorted, the first set to 0."""
    rows = F.transform(F.split(lines, r"\r?\n"), lambda x: F.split(x, ","))
    keyed = F.filter(rows, lambda r: (F.size(r) >= 2) & F.contains(F.get(r, F.lit(1)), F.lit("K")) & F.get(r, F.lit(0)).rlike(r"^\s*\d+(\.\d+)?\s*$"))
    times = F.array_sort(F.transform(keyed, lambda r: F.trim(F.get(r, F.lit(0))).cast("double")))
    return F.when(F.size(times) == 0, times).otherwise(F.concat(F.array(F.lit(0.0)), F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0)))))


def evolve(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` with the columns of ``schema`` that they lack, unknown, and in its order; others stay behind them."""
    known = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return rows.select(*known, *(c for c in rows.columns if c not in schema.fieldNames()))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions below ``path`` that were written to the end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    done = lambda x: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))
    found = [x.getPath() for x in files.listStatus(at)]
    return sorted(int(x.getName()[2:]) for x in found if x.getName().startswith("v=") and x.getName()[2:].isdigit() and done(x))


def write_version(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Write a table whole, as the next version in a folder of its own; readers of :func:`read_latest` see the old
    one until the new one is complete."""
    spark = rows.sparkSession
    own = f"{path}/.writing-{uuid.uuid4().hex}"
    (rows.write.partitionBy(*partition_by) if partition_by else rows.write).parquet(own)
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken = files.listStatus(source.getParent())
    number = max((int(x.getPath().getName()[2:]) for x in taken if re.fullmatch(r"v=\d+", x.getPath().getName())), default=-1) + 1
    # a folder can be made by one writer only; who comes too late takes the next number
    while not _claimed(spark, files, f"{path}/v={number}"):
        number += 1
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={number}")
    for part in sorted(files.listStatus(source), key=lambda x: x.getPath().getName() == "_SUCCESS"):
        files.rename(part.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target, part.getPath().getName()))
    files.delete(source, True)
    return number


def _claimed(spark: SparkSession, files, path: str) -> bool:
    """Whether this writer was the one to claim a version: a file without overwriting can be made once."""
    claim = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_claim")
    try:
        return bool(files.createNewFile(claim))
    except Exception:  # noqa: BLE001  stores tell in their own ways that it is there
        return False


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version; an error that says so where there is none."""
    known = _versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no complete version of a table in {path}")
    return spark.read.parquet(f"{path}/v={max(known)}")


def report(rows: DataFrame, path: str, line: Column) -> None:
    """A text report, a line for each row, in order of the rows' sort."""
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a report, numbered in their order: files by name, and lines as they stand in them."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    kept = cut(lines)
    local = kept.withColumn("__n", F.row_number().over(Window.partitionBy("__file").orderBy("__at")))
    sizes = kept.groupBy("__file").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(sizes.withColumn("__before", before), "__file").select((F.col("__before") + F.col("__n") - 1).cast("int").alias("nth"), "line")
