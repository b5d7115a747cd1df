"""From growing frame files to tracks: a stream of frames is detected batch by batch, a stream of detections is tracked with keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect_frames
from ..operators.tracking import Settings
from ..sources.frames import grey_values
from .tracker import track_stream

DETECTED = (
    "recording_id string, frame_idx bigint, roi_label string, track_id int, det_idx int, cx_px double, cy_px double, area_px double, perimeter_px double, "
    "solidity double, major_axis_px double, minor_axis_px double, orientation_deg double"
)


def detect_stream(frames: DataFrame, background: DataFrame, threshold: float, path: str, checkpoint: str, once: bool = False, **how) -> StreamingQuery:
    """Detections of each batch of frames as a folder of its own under ``path``; a batch that is run again replaces its folder."""

    def run(batch: DataFrame, number: int) -> None:
        detect_frames(grey_values(batch), background, threshold, **how).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = frames.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def track_detected(spark: SparkSession, path: str, out: str, checkpoint: str, settings: Settings | None = None, once: bool = False) -> StreamingQuery:
    """Tracks of the detections that ``detect_stream`` writes to ``path``."""
    found = spark.readStream.schema(DETECTED + ", batch int").option("maxFilesPerTrigger", 1_000_000).parquet(path).drop("batch")
    tracked = track_stream(found, settings).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (tracked.trigger(availableNow=True) if once else tracked).start()


def frames_to_tracks(spark: SparkSession, frames: DataFrame, background: DataFrame, threshold: float, root: str, settings: Settings | None = None, **how) -> DataFrame:
    """Take in the frames that have come since the last call, and return all tracks so far. State and offsets stand under ``root``."""
    detect_stream(frames, background, threshold, f"{root}/detections", f"{root}/detect-state", True, **how).awaitTermination()
    track_detected(spark, f"{root}/detections", f"{root}/tracks", f"{root}/track-state", settings, True).awaitTermination()
    return spark.read.parquet(f"{root}/tracks")
