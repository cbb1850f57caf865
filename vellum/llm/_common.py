"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Whole ``documents``; a null text counts as the empty text."""
    df = table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))
    return df.withColumn("text", F.coalesce("text", F.lit("")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one if Spark runs in this process alone (tests)."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="vellum-")
    return _own_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder, with ``options`` of the writer, and read it back.

    Lost executors then cost a re-read of files, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str) -> Column:
    """A digest of ``columns``: rows have the same key only if they agree in all of them, nulls included."""
    digests = (F.coalesce(F.sha2(F.col(c).cast("string").cast("binary"), 256), F.lit("null")) for c in columns)
    return F.unhex(F.sha2(F.concat_ws(" ", *digests).cast("binary"), 256))


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written table marked for broadcast if it has no more than ``rows`` (narrow) rows; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`scratch_path` named, once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 32 << 20) -> None:
    """Bound what a Python worker holds at once, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
