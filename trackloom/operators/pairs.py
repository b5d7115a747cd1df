"""Pairwise operators: rows of one frame meet by a hash join on the frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import length
from ..schema import FRAME, KEY

SCENE = KEY[:2]


def pairwise_distance(df: DataFrame, px_per_mm: float, x: str = "cx_smooth_px", y: str = "cy_smooth_px") -> DataFrame:
    """Distances in mm of all pairs of tracks at each frame, each pair once (track_i < track_j)."""
    side = lambda s: df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *SCENE, FRAME, F.col("track_id").alias(f"track_{s}"), F.col(x).alias(f"x_{s}"), F.col(y).alias(f"y_{s}")
    )
    met = side("i").join(side("j"), [*SCENE, FRAME]).filter("track_i < track_j")
    gap = length(F.col("x_i") - F.col("x_j"), F.col("y_i") - F.col("y_j")) / px_per_mm
    return met.select(*SCENE, FRAME, "track_i", "track_j", gap.alias("distance_mm"))


def track_grid(df: DataFrame) -> DataFrame:
    """Every track of a scene at every frame that any of its tracks has."""
    frames, tracks = df.select(*SCENE, FRAME).distinct(), df.select(*SCENE, "track_id").distinct()
    return frames.join(tracks, SCENE)


def nearest_neighbour(df: DataFrame, px_per_mm: float, x: str = "cx_smooth_px", y: str = "cy_smooth_px") -> DataFrame:
    """Distance to the nearest other track, for every cell of the grid; NULL where there is none.

    Scenes of one track have no rows.
    """
    pairs = pairwise_distance(df, px_per_mm, x, y)
    ends = pairs.withColumn("track_id", F.explode(F.array("track_i", "track_j")))
    nearest = ends.groupBy(*SCENE, FRAME, "track_id").agg(F.min("distance_mm").alias("nn_mm"))
    several = df.groupBy(*SCENE).agg(F.countDistinct("track_id").alias("_n")).filter("_n >= 2").drop("_n")
    return track_grid(df).join(several, SCENE).join(nearest, [*SCENE, FRAME, "track_id"], "left")


def nn_summary(nn: DataFrame) -> DataFrame:
    """Per track: mean and tenth percentile of the distance to the nearest neighbour."""
    return nn.groupBy(*KEY).agg(F.avg("nn_mm").alias("nn_mean_mm"), F.percentile("nn_mm", F.lit(0.1)).alias("nn_p10_mm"))


def polarisation(df: DataFrame, heading: str = "heading_deg") -> DataFrame:
    """Length of the headings' mean vector at each frame, and how many there are; NULL for fewer than two."""
    a = F.radians(heading)
    sums = df.groupBy(*SCENE, FRAME).agg(F.sum(F.cos(a)).alias("_c"), F.sum(F.sin(a)).alias("_s"), F.count(heading).alias("n_headings"))
    order = F.when(F.col("n_headings") >= 2, F.hypot("_c", "_s") / F.col("n_headings"))
    return sums.select(*SCENE, FRAME, order.alias("polarisation"), "n_headings")


def group_series(nn: DataFrame, order: DataFrame, tracks: list[int]) -> DataFrame:
    """Frame by frame: the nearest-neighbour distance of each track in a column, beside the polarisation."""
    wide = nn.groupBy(*SCENE, FRAME).pivot("track_id", tracks).agg(F.first("nn_mm"))
    wide = wide.withColumnsRenamed({str(t): f"nn_track_{t}_mm" for t in tracks})
    return wide.join(order, [*SCENE, FRAME], "full")


def nearest_sample(df: DataFrame, x: float, y: float, cx: str = "cx_smooth_px", cy: str = "cy_smooth_px") -> DataFrame:
    """Per scene the sample nearest to a point; ties go to the least track, then the earliest frame."""
    d2 = (F.col(cx) - x) * (F.col(cx) - x) + (F.col(cy) - y) * (F.col(cy) - y)
    best = F.min(F.struct(d2.alias("d2"), F.col("track_id"), F.col(FRAME)))
    return df.filter(F.col(cx).isNotNull() & F.col(cy).isNotNull()).groupBy(*SCENE).agg(best.alias("b")).select(*SCENE, "b.*")
