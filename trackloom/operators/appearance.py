"""Appearance fingerprints: patches as arrays, confidence, running references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patches import canonical
from ..functions.scalar import axis_ratio, clip_byte, continuity_score
from ..schema import DEFAULTS, FRAME, KEY
from .pairs import SCENE, pairwise_distance


def expected_area(df: DataFrame, keys: list[str] = KEY[:1]) -> DataFrame:
    return df.groupBy(*keys).agg(F.median("area_px").alias("expected_area_px"))


def animals(df: DataFrame, keys: list[str] = KEY[:1]) -> DataFrame:
    """The most common number of detections in a frame, the least on ties."""
    per_frame = df.groupBy(*keys, FRAME).agg(F.count("*").alias("n"))
    return per_frame.groupBy(*keys).agg(F.mode("n", deterministic=True).alias("n_animals"))


def learned_area(df: DataFrame, frames: int = DEFAULTS["background_frames"], keys: list[str] = KEY[:2]) -> DataFrame:
    """Median area over a recording's first frames. A frame without detections counts if it has a row, with a null area; where
    none of the first frames has an area, learning goes on up to the first that has."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, FRAME, "area_px").withColumn("_r", F.dense_rank().over(w.orderBy(FRAME)))
    ranked = ranked.withColumn("_first", F.min(F.when(F.col("area_px").isNotNull(), F.col("_r"))).over(w))
    return ranked.filter(F.col("_r") <= F.greatest(F.lit(frames), "_first")).groupBy(*keys).agg(F.median("area_px").alias("expected_area_px")).filter("expected_area_px is not null")


def confident_frames(df: DataFrame, n_animals: int, min_distance_px: float, expected_px: float, tolerance: float = DEFAULTS["area_tolerance"], x: str = "cx_px", y: str = "cy_px") -> DataFrame:
    """Per frame whether all animals are there, further apart than a distance and of about the expected area.

    A distance or expected area of 0 or less switches that gate off.
    """
    size = F.col("area_px").between(expected_px * (1 - tolerance), expected_px * (1 + tolerance)) if expected_px > 0 else F.lit(True)
    frames = df.groupBy(*SCENE, FRAME).agg(F.count("*").alias("n"), F.min(F.coalesce(size, F.lit(False))).alias("sized"))
    near = pairwise_distance(df, 1.0, x, y).groupBy(*SCENE, FRAME).agg(F.min("distance_mm").alias("min_px"))
    out = frames.join(near, [*SCENE, FRAME], "left")
    apart = (F.col("min_px") > min_distance_px) | F.col("min_px").isNull() if min_distance_px > 0 else F.lit(True)
    return out.select(*SCENE, FRAME, ((F.col("n") == n_animals) & F.col("sized") & apart).alias("is_confident"))


def canonical_patches(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("patch", canonical(F.col("patch"), width))


def median_patch(df: DataFrame, keys: list[str]) -> DataFrame:
    """Median grey of each pixel, cut to a whole byte; one row per key with the patch as an array."""
    pixels = df.select(*keys, F.posexplode("patch").alias("pos", "v"))
    medians = pixels.groupBy(*keys, "pos").agg(clip_byte(F.median("v")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return medians.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias("patch"))


def running_reference(df: DataFrame, history: int = DEFAULTS["history"], keys: list[str] = KEY, order: str = FRAME) -> DataFrame:
    """Median area and axis ratio of a track's last confident rows, at each such row.

    Rows whose minor axis isn't positive don't count.
    """
    good = df.filter(F.col("is_confident") & (F.col("minor_axis_px") > 0)).withColumn("axis_ratio", axis_ratio(F.col("major_axis_px"), F.col("minor_axis_px")))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - history, Window.currentRow)
    return good.withColumns(
        {
            "median_area_px": F.percentile("area_px", F.lit(0.5)).over(w),
            "median_axis_ratio": F.percentile("axis_ratio", F.lit(0.5)).over(w),
        }
    )


def continuity(df: DataFrame) -> DataFrame:
    """Scores of a row's area and axis ratio against the references beside them."""
    return df.withColumns(
        {
            "area_score": continuity_score(F.col("area_px"), F.col("median_area_px")),
            "axis_ratio_score": continuity_score(F.col("axis_ratio"), F.col("median_axis_ratio")),
        }
    )


def window_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """Medians of area and axis ratio over a window's rows, missing values left out."""
    ratio = axis_ratio(F.col("major_axis_px"), F.col("minor_axis_px"))
    return df.groupBy(*keys).agg(F.median("area_px").alias("area_px"), F.median(ratio).alias("axis_ratio"))


def pose_patches(detections: DataFrame, pixels: DataFrame, height: int = DEFAULTS["patch_h"], width: int = DEFAULTS["patch_w"], pad: float = DEFAULTS["patch_pad"], key: str = "det_idx") -> DataFrame:
    """Each detection's patch: ``height`` x ``width`` greys, row by row, of a rectangle along its long axis.

    The rectangle is ``pad`` times the axes, at least a pixel a cell, and its corners are the patch's corner cells. The long axis stands
    90 degrees before ``orientation_deg``. A cell's grey is bilinear from the four pixels around its place, rounded; what lies outside the
    frame is black. Cells meet pixels by an equal join, so only frames with detections count and frames without pixels give no patch.
    """
    keys = ["recording_id", FRAME, key]
    framed = detections.join(pixels.select("recording_id", FRAME).distinct(), ["recording_id", FRAME], "left_semi")
    long, across = F.greatest(pad * F.col("major_axis_px"), F.lit(float(width))), F.greatest(pad * F.col("minor_axis_px"), F.lit(float(height)))
    cells = framed.select(*keys, "cx_px", "cy_px", F.radians(F.col("orientation_deg") - 90).alias("_t"), long.alias("_w"), across.alias("_h"), F.posexplode(F.sequence(F.lit(0), F.lit(height * width - 1))).alias("pos", "_c"))
    u, v = (F.col("pos") % width / (width - 1) - 0.5) * F.col("_w"), (F.floor(F.col("pos") / width) / (height - 1) - 0.5) * F.col("_h")
    sx = F.col("cx_px") + F.cos("_t") * u - F.sin("_t") * v
    sy = F.col("cy_px") + F.sin("_t") * u + F.cos("_t") * v
    # Places are rounded so that a corner's weight doesn't hang on the last bit.
    cells = cells.select(*keys, "pos", F.round(sx, 6).alias("_sx"), F.round(sy, 6).alias("_sy"))
    corner = lambda dy, dx: F.struct(
        (F.floor("_sy") + dy).cast("int").alias("y"), (F.floor("_sx") + dx).cast("int").alias("x"),
        ((1 - F.abs(F.col("_sy") - F.floor("_sy") - dy)) * (1 - F.abs(F.col("_sx") - F.floor("_sx") - dx))).alias("w"),
    )
    corners = cells.select(*keys, "pos", F.explode(F.array(*[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)])).alias("_k")).select(*keys, "pos", "_k.*")
    met = corners.join(pixels.select("recording_id", FRAME, "y", "x", "v"), ["recording_id", FRAME, "y", "x"], "left")
    grey = met.groupBy(*keys, "pos").agg(clip_byte(F.round(F.sum(F.col("w") * F.coalesce("v", F.lit(0))), 6) + 0.5).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return grey.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias("patch"))


def fingerprints(
    tracked: DataFrame, pixels: DataFrame, n_animals: int, expected_px: float, min_distance_px: float, tolerance: float = DEFAULTS["area_tolerance"],
    height: int = DEFAULTS["patch_h"], width: int = DEFAULTS["patch_w"], pad: float = DEFAULTS["patch_pad"], dark_right: bool = True,
) -> DataFrame:
    """A row for each tracked detection whose frame is there: its patch, whether its frame is confident, and its shape.

    With ``dark_right`` a patch is turned so that its darker half is on the right. Needs the columns of detections; the
    patch's sides stand in each row.
    """
    frames = confident_frames(tracked, n_animals, min_distance_px, expected_px, tolerance).drop("roi_label")
    shape = ["cx_px", "cy_px", "area_px", "major_axis_px", "minor_axis_px", "orientation_deg"]
    patches = pose_patches(tracked, pixels, height, width, pad, "track_id")
    patches = canonical_patches(patches, width) if dark_right else patches
    out = patches.join(tracked.select("recording_id", FRAME, "track_id", *shape), ["recording_id", FRAME, "track_id"]).join(frames, ["recording_id", FRAME])
    return out.select("recording_id", FRAME, "track_id", "patch", "is_confident", *shape, F.lit(height).alias("patch_h"), F.lit(width).alias("patch_w"))


def running_patch(df: DataFrame, history: int = DEFAULTS["history"], keys: list[str] = KEY, order: str = FRAME) -> DataFrame:
    """Median of each pixel over a track's last confident patches, at each such row: ``median_patch``."""
    pixels = df.filter("is_confident").select(*keys, order, F.posexplode("patch").alias("pos", "v"))
    w = Window.partitionBy(*keys, "pos").orderBy(order).rowsBetween(1 - history, Window.currentRow)
    medians = pixels.select(*keys, order, "pos", F.percentile("v", F.lit(0.5)).over(w).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return medians.groupBy(*keys, order).agg(F.transform(ordered, lambda s: s["v"]).alias("median_patch"))
