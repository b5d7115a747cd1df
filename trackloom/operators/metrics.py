"""Per-track and group metrics of trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Shape, centre_and_inscribed_radius, edge_distance, split_regions
from ..functions.scalar import length
from ..schema import DEFAULTS, FRAME, KEY, positive
from ..sources.scratch import keep
from .pairs import nearest_neighbour, nn_summary
from .seq import schmitt


def speed_summary(df: DataFrame, fps: float, keys: list[str] = KEY) -> DataFrame:
    """Median, ninetieth percentile and maximum of speed, and the path's length; missing speeds don't count."""
    positive(fps=fps)
    return df.groupBy(*keys).agg(*_speeds(fps))


def _speeds(fps: float) -> list[Column]:
    return [
        F.median("speed_mm_s").alias("speed_median_mm_s"),
        F.percentile("speed_mm_s", F.lit(0.9)).alias("speed_p90_mm_s"),
        F.max("speed_mm_s").alias("speed_max_mm_s"),
        (F.sum("speed_mm_s") / fps).alias("path_length_mm"),
    ]


def yaw_summary(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return df.groupBy(*keys).agg(*_yaws())


def _yaws() -> list[Column]:
    rate = F.abs("yaw_rate_deg_s")
    return [F.median(rate).alias("yaw_rate_median_abs_deg_s"), F.percentile(rate, F.lit(0.95)).alias("yaw_rate_p95_abs_deg_s")]


def bouts(
    df: DataFrame, fps: float, on: float = DEFAULTS["walk_on_mm_s"], off: float = DEFAULTS["walk_off_mm_s"],
    min_s: float = DEFAULTS["bout_s"], keys: list[str] = KEY, order: str = FRAME,
) -> DataFrame:
    """Walking bouts: runs of rows held on by two thresholds, of ``min_s`` or longer, with their mean speed."""
    positive(fps=fps)
    w = Window.partitionBy(*keys).orderBy(order)
    marked = schmitt(df, "speed_mm_s", on, off, "_on", keys, order).withColumn("_row", F.row_number().over(w))
    walking = marked.filter("_on").withColumn("_island", F.col("_row") - F.row_number().over(w))
    found = walking.groupBy(*keys, "_island").agg(
        F.min(order).alias("frame_start"), F.max(order).alias("frame_end"), (F.count("*") / fps).alias("duration_s"),
        F.avg("speed_mm_s").alias("mean_speed_mm_s"),
    )
    return found.filter(F.col("duration_s") >= min_s).drop("_island")


def bout_summary(df: DataFrame, found: DataFrame, fps: float, keys: list[str] = KEY) -> DataFrame:
    """Bouts, walking time and its part of the track's time, 0 for tracks without bouts."""
    total = df.groupBy(*keys).agg((F.count("*") / fps).alias("total_time_s"))
    walked = found.groupBy(*keys).agg(F.count("*").alias("n_walk_bouts"), F.sum("duration_s").alias("walking_time_s"))
    out = total.join(walked, keys, "left")
    out = out.withColumns({"n_walk_bouts": F.coalesce("n_walk_bouts", F.lit(0)), "walking_time_s": F.coalesce("walking_time_s", F.lit(0.0))})
    return out.withColumn("walking_fraction", F.col("walking_time_s") / F.col("total_time_s"))


def occupancy(df: DataFrame, box: tuple[float, float, float, float], bins: int = DEFAULTS["heat_bins"], keys: list[str] = KEY[:2], x: str = "cx_smooth_px", y: str = "cy_smooth_px") -> DataFrame:
    """Part of the positions in each cell of a grid over ``box`` (x0, y0, x1, y1), of those inside it.

    The last cell of an axis holds its upper edge. Only cells with positions are rows.
    """
    x0, y0, x1, y1 = box
    positive(bins=bins, width=x1 - x0, height=y1 - y0)
    cell = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    inside = df.filter(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    n = inside.groupBy(*keys, cell(y, y0, y1).alias("ybin"), cell(x, x0, x1).alias("xbin")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).drop("n")


def thigmotaxis(df: DataFrame, arena: Shape, outer: float = DEFAULTS["outer_fraction"], keys: list[str] = KEY, x: str = "cx_smooth_px", y: str = "cy_smooth_px") -> DataFrame:
    """Part of a track's positions in the arena's outer ring; radial from the centre for every shape."""
    return df.groupBy(*keys).agg(_outer_part(arena, outer, x, y))


def _outer_part(arena: Shape, outer: float = DEFAULTS["outer_fraction"], x: str = "cx_smooth_px", y: str = "cy_smooth_px") -> Column:
    if not 0 < outer < 1:
        raise ValueError("the outer fraction must be between 0 and 1")
    cx, cy, r = centre_and_inscribed_radius(arena)
    d = length(F.col(x) - cx, F.col(y) - cy)
    near = F.when(d > r * (1 - outer), 1.0).when(d.isNotNull(), 0.0)
    return F.avg(near).alias("thigmotaxis_fraction")


def wall_distance(df: DataFrame, arena: Shape, px_per_mm: float, x: str = "cx_smooth_px", y: str = "cy_smooth_px") -> DataFrame:
    """Add ``wall_mm``: distance to the arena's edge, negative outside."""
    positive(px_per_mm=px_per_mm)
    return df.withColumn("wall_mm", edge_distance(F.col(x), F.col(y), arena) / px_per_mm)


def summarise_tracks(df: DataFrame, fps: float, px_per_mm: float, arena: Shape | None = None, neighbours: bool = True) -> DataFrame:
    """One row per track with all metrics that the inputs allow. What the metrics need is kept as a table, as bouts and
    neighbours read it, too; all else is one aggregation."""
    positive(fps=fps, px_per_mm=px_per_mm)
    needed = [c for c in (*KEY, FRAME, "cx_smooth_px", "cy_smooth_px", "speed_mm_s", "yaw_rate_deg_s") if c in df.columns]
    df = keep(df.select(*needed), "tracks")
    yaws = _yaws() if "yaw_rate_deg_s" in df.columns else []
    out = df.groupBy(*KEY).agg(F.count("*").alias("n_frames"), *_speeds(fps), *yaws, *([_outer_part(arena)] if arena else []))
    out = out.join(bout_summary(df, bouts(df, fps), fps), KEY)
    if neighbours:
        out = out.join(nn_summary(nearest_neighbour(df, px_per_mm)), KEY, "left")
    return out


def flag_counts(df: DataFrame, flags: list[str], keys: list[str] = KEY) -> DataFrame:
    """How many rows of a track have each flag, missing ones counting as not."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(c)).alias(f"n_{c}") for c in flags], F.count("*").alias("n_rows"))


def spread(df: DataFrame, columns: list[str], keys: list[str] = KEY[:2]) -> DataFrame:
    """Mean, population deviation, least and greatest of each column, as for tuning over sampled frames."""
    parts = (("mean", F.avg), ("sd", F.stddev_pop), ("min", F.min), ("max", F.max))
    return df.groupBy(*keys).agg(*[f(c).alias(f"{c}_{name}") for c in columns for name, f in parts])


def extent(df: DataFrame, fps: float, keys: list[str] = KEY[:1]) -> DataFrame:
    """First and last frame of a recording, how many frames it spans, and for how long."""
    positive(fps=fps)
    out = df.groupBy(*keys).agg(F.min(FRAME).alias("first_frame"), F.max(FRAME).alias("last_frame"))
    n = F.col("last_frame") - F.col("first_frame") + 1
    return out.withColumns({"n_frames": n, "duration_s": n / fps})


def by_region(df: DataFrame, regions: list[dict], x: str = "cx_px", y: str = "cy_px") -> DataFrame:
    """The rows once for each adding region that holds them, under its label; those in none are left out."""
    return df.withColumn("roi_label", F.explode(split_regions(F.col(x), F.col(y), regions)))
