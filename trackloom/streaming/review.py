"""Review as a stream: new verdicts re-audit the recordings that they name, and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.review import latest_verdicts

Audit = Callable[[DataFrame, DataFrame], DataFrame]


def audit_stream(verdicts: DataFrame, tracks: DataFrame, audit: Audit, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep verdict rows as they come, and audit the touched recordings anew with all their latest verdicts.

    ``audit`` gets the rows of these recordings and their verdicts. Each batch has folders of its own under ``root``, replaced if it
    runs again, so running a batch twice changes nothing; ``audited`` reads each recording's newest one.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/verdicts/batch={number}")
        log = spark.read.schema(batch.schema).option("basePath", f"{root}/verdicts").parquet(f"{root}/verdicts").filter(F.col("batch") <= number) if number else batch
        touched = batch.select("recording_id").distinct()
        known = latest_verdicts(log.select(batch.columns)).join(touched, "recording_id", "left_semi")
        out = audit(tracks.join(touched, "recording_id", "left_semi"), known)
        out.write.mode("overwrite").parquet(f"{root}/audited/batch={number}")

    stream = verdicts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def audited(spark: SparkSession, root: str) -> DataFrame:
    """The newest audit of each recording, with the batch that made it."""
    rows = spark.read.parquet(f"{root}/audited")
    newest = rows.groupBy("recording_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["recording_id", "batch"], "left_semi")
