"""Folders for intermediate tables that every executor sees."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset: a temporary one in local mode, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local(spark.sparkContext.applicationId)
    return base


@functools.cache
def _local(application: str) -> str:
    """One temporary folder for an application; the setting itself can't be changed in a running session."""
    return f"file://{tempfile.mkdtemp(prefix='trackloom-')}"


def _own(spark: SparkSession) -> str:
    return f"{_base(spark)}/kept-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, beside the others of this application."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def discard_kept(spark: SparkSession) -> None:
    """Delete all that this application kept; nothing that reads it can be run any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_base(spark))


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in a shared folder: made once for all that reads it, and safe from lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt to all cores, by ``keys`` if there are any, for small rows that each cost much (a file, a group's Python):
    by its bytes adaptive execution would put such a table into one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)
