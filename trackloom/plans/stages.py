"""The stages of an analysis, with defaults, and a handle for one set of recordings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Shape, pixel_to_world
from ..operators import audit, clean, events, heading, metrics, pairs, tracking
from ..schema import FRAME, positive


@dataclass(frozen=True)
class Meta:
    """What a recording's sidecar tells: frame rate, scale, arena, origin and axes."""

    fps: float
    px_per_mm: float
    arena: Shape | None = None
    origin: tuple[float, float] = (0.0, 0.0)
    x_axis: str = "right"
    y_axis: str = "up"

    def __post_init__(self) -> None:
        positive(fps=self.fps, px_per_mm=self.px_per_mm)


def trim(df: DataFrame, start: int | None = None, end: int | None = None, every: int = 1) -> DataFrame:
    """Frames of [start, end), every N-th from the start; a filter that reaches the scan."""
    if every < 1:
        raise ValueError("every must be 1 or more")
    lo = start or 0
    df = df.filter(F.col(FRAME) >= lo)
    df = df.filter(F.col(FRAME) < end) if end is not None else df
    return df.filter(F.pmod(F.col(FRAME) - lo, F.lit(every)) == 0) if every > 1 else df


def first_frames(df: DataFrame, n: int) -> DataFrame:
    """The rows of each recording's first n frames that have rows."""
    from ..operators.seq import frame_ranks

    return df.join(frame_ranks(df).filter(F.col("rank") < n).drop("rank"), ["recording_id", "roi_label", FRAME])


def world(df: DataFrame, meta: Meta) -> DataFrame:
    w = pixel_to_world(F.col("cx_px"), F.col("cy_px"), meta.origin, 1 / meta.px_per_mm, meta.x_axis, meta.y_axis)
    return df.withColumns({"x_mm": w["x_mm"], "y_mm": w["y_mm"]})


def with_meta(df: DataFrame, meta: DataFrame, fps: float | None = None, px_per_mm: float | None = None) -> DataFrame:
    """Rows with their recording's ``fps`` and ``px_per_mm`` from a table of sidecars; numbers given here hold for all. A row
    for each recording is small beside its frames; adaptive execution broadcasts it where it fits."""
    known = meta.select("recording_id", F.col("fps").cast("double").alias("fps"), F.col("px_per_mm").cast("double").alias("px_per_mm"))
    out = df.join(known, "recording_id", "left")
    given = {"fps": fps, "px_per_mm": px_per_mm}
    return out.withColumns({c: F.coalesce(F.lit(v).cast("double"), F.col(c)) for c, v in given.items()})


def trajectory(detections: DataFrame, meta: Meta, **options) -> DataFrame:
    """Clean, resolve headings, add yaw."""
    cleaned = clean.clean_tracks(detections, meta.fps, meta.px_per_mm, **options)
    return heading.add_yaw(heading.resolve_headings(cleaned), meta.fps)


@dataclass(frozen=True)
class Recording:
    """A table of one or more recordings with their common metadata, and the stages on it."""

    df: DataFrame
    meta: Meta

    def _with(self, df: DataFrame) -> Recording:
        return Recording(df, self.meta)

    def trim(self, start: int | None = None, end: int | None = None, every: int = 1) -> Recording:
        return self._with(trim(self.df, start, end, every))

    def track(self, settings: tracking.Settings | None = None) -> Recording:
        return self._with(tracking.track_detections(self.df, settings))

    def clean(self, **options) -> Recording:
        return self._with(trajectory(self.df, self.meta, **options))

    def candidates(self) -> DataFrame:
        return events.detect_candidates(self.df, self.meta.fps, self.meta.px_per_mm)

    def audit(self, verdicts: DataFrame | None = None, **options) -> tuple[Recording, DataFrame]:
        out, log = audit.audit_tracks(self.df, self.meta.fps, self.meta.px_per_mm, verdicts=verdicts, **options)
        return self._with(out), log

    def summary(self) -> DataFrame:
        return metrics.summarise_tracks(self.df, self.meta.fps, self.meta.px_per_mm, self.meta.arena)

    def group_series(self, tracks: list[int]) -> DataFrame:
        nn = pairs.nearest_neighbour(self.df, self.meta.px_per_mm)
        return pairs.group_series(nn, pairs.polarisation(self.df), tracks)
