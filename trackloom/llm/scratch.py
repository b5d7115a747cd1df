"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
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


class Scratch:
    """Tables of one operator call, written as Parquet so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in names:
            files.delete(path(f"{self.root}/{name}"), True)

    def keep_only(self, name: str) -> None:
        """Delete all tables of this call but one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        self.drop(*(n for n in (x.getPath().getName() for x in there) if n != name))
