"""Blobs as outlines: ordered border points, their measures, and outlines cut in two.

An outline is an array of ``struct<x, y>`` whose corners are pixel centres. A frame is the unit of work: its
foreground runs meet once, grouped by frame, and everything about an outline is computed from its own array.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import runs as rows
from ..functions.batches import few
from ..schema import FRAME
from .raster import IMAGE, row_runs

#: Points that an outline needs to be measured, and each half of a cut one.
LEAST_POINTS = 5
#: An outline of more than this many animals' area is taken for several.
MERGED = 1.5


def outlines(fg: DataFrame) -> DataFrame:
    """The outer border of every 8-connected blob that isn't inside another one: image, blob (its number in the frame), points.

    Points start at the topmost, leftmost pixel and go down first; holes don't count.
    """
    return traced(row_runs(fg))


def traced(runs: DataFrame) -> DataFrame:
    """As ``outlines``, of a table of unbroken runs: image, y, x0, x1."""
    frames = runs.groupBy(*IMAGE).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            which, numbers, points = [], [], []
            for i, found in enumerate(batch.column("runs").to_pylist()):
                for number, blob in enumerate(rows.blobs(rows.filled([(r["y"], r["x0"], r["x1"]) for r in found]))):
                    which.append(i)
                    numbers.append(number)
                    points.append([{"x": x, "y": y} for x, y in rows.border(blob)])
            image = batch.select(IMAGE).take(pa.array(which, pa.int64()))
            kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*image.columns, pa.array(numbers, pa.int32()), pa.array(points, kind)], names=[*IMAGE, "blob", "points"])

    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in IMAGE)
    return frames.mapInArrow(run, f"{kinds}, blob int, points array<struct<x:int,y:int>>")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def steps(points: Column) -> Column:
    """The sides of the closed outline: (x, y) to (u, v)."""
    ahead = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    d = lambda c: c.cast("double")
    return F.zip_with(points, ahead, lambda p, q: F.struct(d(p["x"]).alias("x"), d(p["y"]).alias("y"), d(q["x"]).alias("u"), d(q["y"]).alias("v")))


def arc_length(sides: Column) -> Column:
    return _total(F.transform(sides, lambda s: F.sqrt((s["u"] - s["x"]) * (s["u"] - s["x"]) + (s["v"] - s["y"]) * (s["v"] - s["y"]))))


def moments(sides: Column) -> Column:
    """Green's integrals of 1, x, y, xx, xy and yy over the outline, signed by its sense."""
    cross = lambda s: s["x"] * s["v"] - s["u"] * s["y"]
    terms = {
        "m00": lambda s: cross(s) / 2,
        "m10": lambda s: cross(s) * (s["x"] + s["u"]) / 6,
        "m01": lambda s: cross(s) * (s["y"] + s["v"]) / 6,
        "m20": lambda s: cross(s) * (s["x"] * s["x"] + s["x"] * s["u"] + s["u"] * s["u"]) / 12,
        "m02": lambda s: cross(s) * (s["y"] * s["y"] + s["y"] * s["v"] + s["v"] * s["v"]) / 12,
        "m11": lambda s: cross(s) * (2 * s["x"] * s["y"] + s["x"] * s["v"] + s["u"] * s["y"] + 2 * s["u"] * s["v"]) / 24,
    }
    return F.struct(*[_total(F.transform(sides, f)).alias(n) for n, f in terms.items()])


def hull_area(points: Column) -> Column:
    """Area of the convex hull.

    The hull of the points' rows is what lies between the lower envelope of their left ends and the upper one of
    their right ends; an envelope goes from a row to the one that it reaches with the least slope.
    """
    ys = F.array_sort(F.array_distinct(F.transform(points, lambda p: p["y"])))
    ends = F.transform(ys, lambda y: _let(F.transform(F.filter(points, lambda p: p["y"] == y), lambda p: p["x"]), lambda xs: F.struct(y.cast("double").alias("y"), F.array_min(xs).cast("double").alias("a"), (-F.array_max(xs)).cast("double").alias("b"))))

    def under(rows: Column, side: str) -> Column:
        """Twice the area between the envelope of a side and the axis."""

        def step(state: Column, k: Column) -> Column:
            at = lambda i: F.get(rows, i)
            slope = lambda j: (at(j)[side] - at(k)[side]) / (at(j)["y"] - at(k)["y"])
            reached = F.array_min(F.transform(F.sequence(k + 1, F.size(rows) - 1), lambda j: F.struct(slope(j).alias("s"), (-j).alias("j"))))["j"] * -1
            moved = _let(reached, lambda j: F.struct(j.alias("at"), (state["sum"] + (at(k)[side] + at(j)[side]) * (at(j)["y"] - at(k)["y"])).alias("sum")))
            return F.when((state["at"] == k) & (k < F.size(rows) - 1), moved).otherwise(state)

        return F.aggregate(F.sequence(F.lit(0), F.size(rows) - 1), F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum")), step)["sum"]

    return _let(ends, lambda rows: (-under(rows, "b") - under(rows, "a")) / 2)


def measured(found: DataFrame) -> DataFrame:
    """Area, arc length, centroid, solidity and the axes of the ellipse of equal moments of the outlines in ``points``.

    Without area the centroid is the points' mean, the solidity 1 and the axes are 0. ``n_points`` counts corners.
    """
    out = found.withColumn("n_points", F.size("points")).withColumn("_s", steps(F.col("points"))).withColumn("_m", moments(F.col("_s")))
    m = lambda n: F.col(f"_m.{n}") / F.col("_m.m00")
    mean = lambda c: _total(F.transform("points", lambda p: p[c].cast("double"))) / F.size("points")
    out = out.withColumns(
        {
            "area_px": F.abs("_m.m00"), "perimeter_px": arc_length(F.col("_s")), "_hull": hull_area(F.col("points")),
            "cx_px": F.when(F.col("_m.m00") != 0, m("m10")).otherwise(mean("x")), "cy_px": F.when(F.col("_m.m00") != 0, m("m01")).otherwise(mean("y")),
        }
    ).withColumns(
        {
            "solidity": F.when(F.col("_hull") > 0, F.col("area_px") / F.col("_hull")).otherwise(F.lit(1.0)),
            "_xx": F.when(F.col("area_px") > 0, m("m20") - F.col("cx_px") * F.col("cx_px")).otherwise(F.lit(0.0)),
            "_yy": F.when(F.col("area_px") > 0, m("m02") - F.col("cy_px") * F.col("cy_px")).otherwise(F.lit(0.0)),
            "_xy": F.when(F.col("area_px") > 0, m("m11") - F.col("cx_px") * F.col("cy_px")).otherwise(F.lit(0.0)),
        }
    )
    half, root = (F.col("_xx") + F.col("_yy")) / 2, F.sqrt((F.col("_xx") - F.col("_yy")) * (F.col("_xx") - F.col("_yy")) + 4 * F.col("_xy") * F.col("_xy")) / 2
    return out.withColumns(
        {
            "major_axis_px": 4 * F.sqrt(half + root),
            "minor_axis_px": 4 * F.sqrt(F.greatest(half - root, F.lit(0.0))),
            # rounded, so that a level axis is 0 and never nearly 180
            "axis_deg": F.pmod(F.round(F.degrees(F.atan2(2 * F.col("_xy"), F.col("_xx") - F.col("_yy"))) / 2, 9), F.lit(180.0)),
        }
    ).drop("_s", "_m", "_hull", "_xx", "_yy", "_xy")


def gate_area(found: DataFrame, least: float = 20, most: float = 5000) -> DataFrame:
    """Outlines whose area is in a range, both ends included, with what ``measured`` adds."""
    return measured(found).filter(F.col("area_px").between(least, most))


def split_chains(sized: DataFrame, expected_area: float | Column, factor: float = MERGED) -> DataFrame:
    """Outlines of more than ``factor`` animals' area, cut at the centroid across the long axis; measured anew, with their ``part``.

    A part keeps its own border points and is closed by a straight side. An outline stays whole (part 0) where it has
    fewer than ten points or a half would have fewer than five.
    """
    axis = F.radians("axis_deg")
    # Rounded, so that a point on the cut doesn't hang on the last bit: it goes to the first part.
    along = lambda p: F.round((p["x"] - F.col("cx_px")) * F.cos(axis) + (p["y"] - F.col("cy_px")) * F.sin(axis), 9)
    out = sized.withColumns({"_a": F.filter("points", lambda p: along(p) >= 0), "_b": F.filter("points", lambda p: along(p) < 0)})
    big = (F.col("area_px") > factor * expected_area) & (F.col("n_points") >= 2 * LEAST_POINTS)
    cut = big & (F.size("_a") >= LEAST_POINTS) & (F.size("_b") >= LEAST_POINTS)
    parts = F.posexplode(F.when(cut, F.array("_a", "_b")).otherwise(F.array("points"))).alias("part", "points")
    keys = [c for c in (*IMAGE, "blob", "basin") if c in sized.columns]
    return measured(out.select(*keys, parts))
