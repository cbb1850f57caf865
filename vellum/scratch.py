"""Lineage cut through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """A folder of this application below the session's checkpoint folder, deleted when it ends.

    Where no checkpoint folder is set, a temporary one is taken if Spark runs in this process alone (tests).
    """
    context = spark.sparkContext
    if context.applicationId not in _made:
        named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"{(named or 'file://' + tempfile.mkdtemp(prefix='vellum-')).rstrip('/')}/vellum-{context.applicationId}"
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _made[context.applicationId] = path
    return _made[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """``df`` as it was worked out once: later uses read the shared folder, also when executors were lost."""
    path = f"{shared(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
