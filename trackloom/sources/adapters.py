"""Detections, patches and review tables made from generic event and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FPS, PX_PER_MM = 1.0, 10.0
ARENA = {"shape": "circle", "cx": 245.0, "cy": 200.0, "r": 180.0}
BOX = {"shape": "rectangle", "vertices": [(0.0, 0.0), (490.0, 0.0), (490.0, 400.0), (0.0, 400.0)]}


#: Users per recording, each a track.
TRACKS = 4


def detections_from_events(events: DataFrame, tracks: int = TRACKS) -> DataFrame:
    """Each event is a detection: of a user's track, in the recording of a few users, at the next frame.

    Value is x, and k of the properties gives y and angle. A track's frames follow the order of its
    events; every fifth frame and, after each 23rd event, four more are left out, at other places in
    each track. Recordings grow in number with the users.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    track = F.pmod("user_id", F.lit(tracks))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = events.select("user_id", track.cast("int").alias("track_id"), n.alias("n"), "value", k.alias("k"))
    frame = F.col("n") + F.floor((F.col("n") + F.col("track_id")) / 5) + 4 * F.floor((F.col("n") + 3 * F.col("track_id")) / 23)
    return rows.select(
        F.concat(F.lit("r"), F.floor(F.col("user_id") / tracks).cast("string")).alias("recording_id"),
        F.lit("_merged").alias("roi_label"),
        "track_id",
        frame.cast("bigint").alias("frame_idx"),
        F.col("value").alias("cx_px"),
        (F.col("k") * 4.0).alias("cy_px"),
        ((F.col("k") * 7) % 180).cast("double").alias("orientation_deg"),
        (F.col("k") + 100).cast("double").alias("area_px"),
        (F.col("k") + 20).cast("double").alias("major_axis_px"),
        (F.col("k") % 10 + 10).cast("double").alias("minor_axis_px"),
    )


def patches_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """An 8 x 8 patch of grey values per vector: track is the label, order the id. Greys are made in single precision, as the vectors are."""
    single = lambda n: F.lit(float(n)).cast("float")  # a whole number beside a float would make a double
    grey = F.transform("embedding", lambda v: F.floor(F.least(F.greatest(F.round(v.cast("float") * single(100) + single(128)), F.lit(0)), F.lit(255))).cast("int"))
    return embeddings.select("vec_id", F.col("label").alias("track_id"), grey.alias("patch"))
