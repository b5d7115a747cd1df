"""From frames to detections: foreground, clean-up, outlines, gates, merged animals taken apart."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import fold_regions
from ..functions.runs import simplified
from ..sources.scratch import keep
from . import outlines, separate
from .raster import IMAGE, dilate, erode, foreground, masked, morph_close, morph_open


def gate_solidity(found: DataFrame, least: float = 0.0) -> DataFrame:
    """Drop what fills less than ``least`` of its hull; 0 switches the gate off."""
    return found.filter(F.col("solidity") >= least) if least > 0 else found


def gate_ratio(found: DataFrame, most: float = 0.0) -> DataFrame:
    """Drop what is longer than ``most`` times its width; 0 switches the gate off, and so does a width of 0."""
    if most <= 0:
        return found
    return found.filter((F.col("minor_axis_px") <= 0) | (F.col("major_axis_px") / F.col("minor_axis_px") <= most))


def foreground_mask(pixels: DataFrame, background: DataFrame, threshold: float, kernel: int = 1, dilations: int = 0, erosions: int = 0, regions: list[dict] | None = None) -> DataFrame:
    """Pixels darker than the background, opened, closed, grown and shrunk (a kernel of 1 does none of these), inside the regions."""
    fg = foreground(pixels, background, threshold)
    if kernel > 1:
        fg = morph_close(morph_open(fg, kernel), kernel)
        for _ in range(dilations):
            fg = dilate(fg, kernel)
        for _ in range(erosions):
            fg = erode(fg, kernel)
    return masked(fg, regions) if regions else fg


def detect_frames(
    pixels: DataFrame, background: DataFrame, threshold: float, kernel: int = 1, regions: list[dict] | None = None, min_area: float = 20, max_area: float = 5000,
    max_ratio: float = 0.0, min_solidity: float = 0.0, dilations: int = 0, erosions: int = 0, expected_area: float | None = None, splitter: str = "watershed",
    n_animals: int | None = None,
) -> DataFrame:
    """Detections of all frames: foreground, outlines within the area gate, merged ones taken apart, then the gates on shape.

    Outlines of fewer than five points don't count. With ``expected_area``, an animal's, larger outlines are parted into basins or,
    with the splitter ``chain``, cut across; with ``n_animals``, too, frames that lack some get ellipses from arcs of their outlines. Where there are
    regions a rounded centroid, too, must lie in them. A frame's detections are numbered (``det_idx``) from the
    largest, ties by blob and part. ``orientation_deg`` is 90 degrees past the long axis. ``track_id`` is that
    number until a tracker gives others.
    """
    if splitter not in ("watershed", "chain"):
        raise ValueError(f"no such splitter: {splitter}")
    drawn = keep(outlines.outlines(foreground_mask(pixels, background, threshold, kernel, dilations, erosions, regions)), "outlines")
    found = outlines.gate_area(drawn, min_area, max_area)
    if expected_area is None:
        found = found.withColumn("part", F.lit(0))
    else:
        found = separate.split_basins(found, expected_area) if splitter == "watershed" else outlines.split_chains(found, expected_area)
    found = gate_ratio(gate_solidity(found.filter(F.col("n_points") >= outlines.LEAST_POINTS), min_solidity), max_ratio)
    found = found.withColumn("orientation_deg", F.pmod(F.col("axis_deg") + 90, F.lit(180.0)))
    measures = ["cx_px", "cy_px", "area_px", "perimeter_px", "solidity", "major_axis_px", "minor_axis_px", "orientation_deg"]
    inside = lambda df: df.filter(fold_regions(F.bround("cx_px"), F.bround("cy_px"), regions)) if regions else df
    found = inside(found.select(*IMAGE, "blob", "part", *measures))
    if expected_area is not None and n_animals is not None:
        found = keep(found, "found")
        more = inside(separate.rescued(found, drawn, n_animals, expected_area))
        found = found.unionByName(more.withColumn("part", F.lit(-1)))
    w = Window.partitionBy(*IMAGE).orderBy(F.desc("area_px"), "blob", "part")
    found = found.withColumn("det_idx", (F.row_number().over(w) - 1).cast("int"))
    return found.select(*IMAGE, F.lit("_merged").alias("roi_label"), F.col("det_idx").alias("track_id"), "det_idx", *measures)


def auto_regions(
    background: DataFrame, reference: DataFrame, threshold: float = 30, kernel: int = 5, erosions: int = 1, dilations: int = 3, min_area: float = 100,
    tolerance: float = 2.0, arena: list[dict] | None = None,
) -> DataFrame:
    """A polygon around every blob where two backgrounds differ inside the arena, per recording: operation, label, vertices.

    Blobs of less than ``min_area`` are left out; corners are those that leave no border point further off than ``tolerance``.
    """
    both = background.join(reference.withColumnRenamed("bg", "_ref"), ["recording_id", "y", "x"])
    fg = both.filter(F.abs(F.col("bg") - F.col("_ref")) > threshold).select("recording_id", F.lit(0).cast("bigint").alias("frame_idx"), "y", "x")
    fg = masked(fg, arena) if arena else fg
    for _ in range(erosions if kernel > 1 else 0):
        fg = erode(fg, kernel)
    for _ in range(dilations if kernel > 1 else 0):
        fg = dilate(fg, kernel)
    found = outlines.gate_area(outlines.outlines(fg), min_area, float("inf")).select("recording_id", "blob", "area_px", "points")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            corners = [[{"x": x, "y": y} for x, y in simplified([(p["x"], p["y"]) for p in o], tolerance)] for o in batch.column("points").to_pylist()]
            kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(corners, kind)], names=["recording_id", "blob", "area_px", "vertices"])

    name = found.schema["recording_id"].dataType.simpleString()
    out = found.mapInArrow(run, f"recording_id {name}, blob int, area_px double, vertices array<struct<x:int,y:int>>")
    return out.filter(F.size("vertices") >= 3).select("recording_id", "blob", F.lit("add").alias("operation"), F.lit("auto").alias("label"), "area_px", "vertices")
