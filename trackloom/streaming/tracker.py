"""Tracking and review as streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import SCENE, Settings, run_frames
from ..schema import FRAME


def track_stream(detections: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Tracks of a stream of detections; one keyed state (tracks, next id, last frame) per region of a recording.

    Frames of a region must come in order between batches; rows of frames already done are dropped.
    Inside a batch they are put in order.
    """
    s = settings or Settings()
    rows = detections.drop("track_id").filter(F.col("cx_px").isNotNull() & F.col("cy_px").isNotNull())
    columns = rows.columns
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", track_id int"

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks, next_id, last = pickle.loads(state.get[0]) if state.exists else ({}, 0, None)
        pdf = pd.concat(list(parts), ignore_index=True)
        if last is not None:
            pdf = pdf[pdf[FRAME] > last]
        if len(pdf):
            out, tracks, next_id = run_frames(pdf, tracks, next_id, s)
            state.update((pickle.dumps((tracks, next_id, int(pdf[FRAME].max()))),))
            yield out[[*columns, "track_id"]]

    return rows.groupBy(*SCENE).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def event_rate_stream(detections: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Detections per window of event time and region, late rows counted up to a watermark; needs ``ts``."""
    return (
        detections.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{minutes} minutes"), *SCENE)
        .agg(F.count("*").alias("n"), F.avg("cx_px").alias("cx_px"), F.avg("cy_px").alias("cy_px"))
    )


def verdict_stream(log: DataFrame, path: str, checkpoint: str):
    """Append a stream of verdict rows to a table; its reader takes the last row of each event."""
    return log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
