"""Detections to cleaned trajectories: gaps, outliers, smoothing, velocity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULTS, FRAME, KEY, positive, require
from .seq import densify, fill_both, flag_outliers, gradient, interpolate_gaps, refuse_repeats, smooth


def clean_tracks(
    detections: DataFrame,
    fps: float,
    px_per_mm: float,
    max_gap: int | None = None,
    max_speed_mm_s: float = DEFAULTS["max_speed_mm_s"],
    window: int = DEFAULTS["smooth_window"],
    degree: int = DEFAULTS["smooth_order"],
    keys: list[str] = KEY,
) -> DataFrame:
    """One row per frame of a track, with ``interpolated, outlier_rejected``, smoothed positions and velocity.

    ``interpolated`` means that nothing was observed, even where the gap was too long to fill. Only
    positions are filled. Unless given, gaps of up to a twelfth of a second are.
    """
    positive(fps=fps, px_per_mm=px_per_mm)
    max_gap = round(fps / DEFAULTS["gap_divisor"]) if max_gap is None else max_gap
    df = densify(refuse_repeats(require(detections, *keys, FRAME, "cx_px", "cy_px"), keys), keys)
    df = df.withColumn("interpolated", ~(F.col("observed") & F.col("cx_px").isNotNull() & F.col("cy_px").isNotNull()))
    df = flag_outliers(df, max_speed_mm_s, fps / px_per_mm, keys=keys)
    df = df.withColumns({c: F.when(~F.col("outlier_rejected"), F.col(c)) for c in ("cx_px", "cy_px")})
    df = interpolate_gaps(df, ["cx_px", "cy_px"], max_gap, keys)
    df = smooth(df, {"cx_px": "cx_smooth_px", "cy_px": "cy_smooth_px"}, window, degree, keys)
    df = gradient(df, {"cx_smooth_px": "vx_mm_s", "cy_smooth_px": "vy_mm_s"}, fps / px_per_mm, keys)
    return df.withColumn("speed_mm_s", F.hypot("vx_mm_s", "vy_mm_s")).drop("observed")


def fill_labels(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Carry a label over the rows that densifying made."""
    return df.withColumn(column, fill_both(column, keys))
