"""A walk through mounted folders as a Spark data source: files as rows, and errors as rows beside them.

The driver lists only the folders next to the root, each of which is a partition; what is
below them is listed on executors. A folder or file that can't be read gives a row with
``operation`` and ``error`` and doesn't stop the walk. Links are passed over, since they
often lead back to where the walk has been, and so are folders that never hold films.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .listing import IGNORED_FOLDERS, SIDE_WORDS

SCHEMA = "path string, size long, modified timestamp, operation string, error string"

_SIDE = re.compile(rf"(?<![^\W_])(?:{'|'.join(SIDE_WORDS)})(?![^\W_])", re.I)


def passed_over(name: str) -> bool:
    """Whether a folder of this name is not walked into."""
    return name.lower() in IGNORED_FOLDERS or (name.startswith(".") and name not in (".", "..")) or _SIDE.search(name) is not None


def _reason(error: OSError) -> str:
    return error.strerror or str(error)


def _listed(folder: str) -> tuple[list[tuple], list[str]]:
    """Rows of one folder's files, and the folders in it."""
    rows, folders = [], []
    try:
        with os.scandir(folder) as entries:
            for entry in entries:
                try:
                    if entry.is_symlink():
                        continue
                    if entry.is_dir(follow_symlinks=False):
                        if not passed_over(entry.name):
                            folders.append(entry.path)
                    elif entry.is_file(follow_symlinks=False):
                        found = entry.stat(follow_symlinks=False)
                        rows.append((entry.path, found.st_size, datetime.fromtimestamp(found.st_mtime, timezone.utc), None, None))
                except OSError as e:
                    rows.append((entry.path, None, None, "stat", _reason(e)))
    except OSError as e:
        rows.append((folder, None, None, "list", _reason(e)))
    return rows, folders


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, root: str, levels: int):
        self.root, self.levels = root, levels

    def partitions(self) -> list[Folder]:
        """A partition for each folder ``levels`` below the root, and one for the files of each folder above them."""
        out, level = [], [self.root]
        for _ in range(self.levels):
            out += [Folder(f, False) for f in level]
            level = [x for f in level for x in _listed(f)[1]]
        return out + [Folder(f, True) for f in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        left = [partition.path]
        while left:
            rows, folders = _listed(left.pop())
            yield from rows
            if partition.deep:
                left += folders


class FolderSource(DataSource):
    """``spark.read.format("folders").option("levels", 1).load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"].rstrip("/") or "/", int(self.options.get("levels", "1")))


def walk(spark: SparkSession, root: str, levels: int = 1) -> DataFrame:
    """Files and errors below ``root``, a folder that all executors have mounted."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folders").option("levels", levels).load(root)


def files(walked: DataFrame) -> DataFrame:
    return walked.filter("error is null").select("path", "size", "modified")


def errors(walked: DataFrame) -> DataFrame:
    return walked.filter("error is not null").select("path", "operation", "error")


def mark_gone(old: DataFrame, walked: DataFrame, path: str = "path", flag: str = "present") -> DataFrame:
    """``old`` after a walk: ``flag`` is true for files that were seen and false for those that weren't. A file that could
    not be read, or that is below a folder that could not be listed, keeps its flag: nobody knows whether it is there.

    Only rows that weren't seen ask for the folders above them, so the join has as many rows as their paths have parts.
    """
    seen = walked.filter("error is null").select(F.col("path").alias(path)).distinct()
    missing = old.select(path).distinct().join(seen, path, "left_anti")
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.coalesce(F.nullif(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("")), F.lit("/")))
    unread = walked.filter("error is not null").select(F.col("path").alias("__above")).distinct()
    unknown = missing.select(path, F.explode(above).alias("__above")).join(unread, "__above", "left_semi").select(path).distinct()
    told = seen.withColumn("__state", F.lit(True)).unionByName(missing.join(unknown, path, "left_anti").withColumn("__state", F.lit(False)))
    return old.join(told, path, "left").withColumn(flag, F.coalesce("__state", flag)).select(*old.columns)
