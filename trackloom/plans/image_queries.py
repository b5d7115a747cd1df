"""Registered queries of the image stage: vectors read as 8 x 8 frames, a recording for each label."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import detect, outlines, raster, separate
from ..schema import FRAME
from ..sources.scratch import keep
from .queries import REC, _foreground, _pixels, _r

MEASURES = ["area_px", "perimeter_px", "cx_px", "cy_px", "solidity", "major_axis_px", "minor_axis_px"]
#: Columns 0 to 6 of a frame.
WINDOW = [{"operation": "add", "geometry": geometry.rectangle((0, 0), (6, 7))}]


def _outlines(spark, sf_dir):
    return outlines.outlines(_foreground(spark, sf_dir))


def _background(px):
    return raster.projections(px).select(REC, "y", "x", F.col("v_max").alias("bg"))


def blob_features(spark, sf_dir):
    return _r(outlines.measured(_outlines(spark, sf_dir)), [FRAME, "blob", "n_points"], MEASURES)


def blob_contours(spark, sf_dir):
    """The border points of every blob, in order."""
    return _outlines(spark, sf_dir).select(FRAME, "blob", F.posexplode("points").alias("place", "p")).select(FRAME, "blob", "place", "p.x", "p.y")


def blob_perimeter(spark, sf_dir):
    return _r(outlines.measured(_outlines(spark, sf_dir)), [FRAME, "blob", "n_points"], ["area_px", "perimeter_px"])


def blob_solidity(spark, sf_dir):
    """Areas of the hulls and the part of them that blobs fill."""
    found = outlines.measured(_outlines(spark, sf_dir)).withColumn("hull_px", outlines.hull_area(F.col("points")))
    return _r(found, [FRAME, "blob"], ["hull_px", "solidity"])


def solidity_gate(spark, sf_dir):
    """Blobs of five points or more that fill 0.6 of their hull."""
    found = outlines.measured(_outlines(spark, sf_dir)).filter(F.col("n_points") >= outlines.LEAST_POINTS)
    return detect.gate_solidity(found, 0.6).select(FRAME, "blob", "n_points")


def chain_split(spark, sf_dir):
    out = outlines.split_chains(outlines.gate_area(_outlines(spark, sf_dir), 2, 64), 8.0)
    return _r(out, [FRAME, "blob", "part", "n_points"], MEASURES)


def detect_frames(spark, sf_dir):
    """The whole detector: clean-up, a region, outlines, merged ones cut, gates."""
    px = _pixels(spark, sf_dir)
    out = detect.detect_frames(px, _background(px), 20, 3, WINDOW, 2, 64, max_ratio=3.7, min_solidity=0.55, dilations=1, erosions=1, expected_area=9.0, splitter="chain")
    return _r(out, [FRAME, "det_idx"], MEASURES)


def _enlarged(spark, sf_dir, times=6):
    """Outlines of the dark pixels of each frame, enlarged to squares: a run becomes as many longer ones. Kept, as it is read several times."""
    px = _pixels(spark, sf_dir)
    fg = raster.foreground(px, _background(px), 20)
    side = F.sequence(F.lit(0), F.lit(times - 1))
    runs = raster.row_runs(fg).withColumn("dy", F.explode(side))
    large = runs.select(REC, FRAME, (F.col("y") * times + F.col("dy")).alias("y"), (F.col("x0") * times).alias("x0"), ((F.col("x1") + 1) * times - 1).alias("x1"))
    return keep(outlines.gate_area(outlines.traced(large), 20, 2000), "enlarged")


def watershed_split(spark, sf_dir):
    """Outlines of more than three squares parted into basins, else cut across."""
    out = separate.split_basins(_enlarged(spark, sf_dir), 50.0, apart=3, depth=2)
    return _r(out, [FRAME, "blob", "part", "n_points"], MEASURES)


def arc_rescue(spark, sf_dir):
    """Ellipses on arcs, for frames of fewer than five outlines of one to two squares."""
    found = _enlarged(spark, sf_dir)
    return _r(separate.rescued(found.filter("area_px <= 60"), found, 5, 60.0), [FRAME, "blob"], ["cx_px", "cy_px", "area_px", "perimeter_px", "major_axis_px", "minor_axis_px"])


def auto_regions(spark, sf_dir):
    """Regions of each recording where its brightest and darkest projections differ much."""
    both = raster.projections(_pixels(spark, sf_dir))
    side = lambda c: both.select(REC, "y", "x", F.col(c).alias("bg"))
    out = detect.auto_regions(side("v_max"), side("v_min"), 52, kernel=1, min_area=1, tolerance=0.1)
    return _r(out.select(F.col(REC).cast("int").alias("label"), "blob", "operation", "area_px"), ["label", "blob", "operation"], ["area_px"])


QUERIES = {f.__name__: f for f in (blob_features, blob_contours, blob_perimeter, blob_solidity, solidity_gate, chain_split, watershed_split, arc_rescue, detect_frames, auto_regions)}
