"""Animals that touch: merged outlines parted into basins, and animals missing from a frame found on arcs of its outlines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basins import basins
from ..functions.batches import few
from ..functions.ellipses import fit
from ..functions.scalar import ellipse_area, ellipse_perimeter, suppression_radius
from ..sources.scratch import keep
from .outlines import LEAST_POINTS, MERGED, measured, split_chains
from .raster import IMAGE

#: Pixels between peaks of two animals, and a peak's least depth.
APART, DEPTH = 8, 2
#: Length of an arc, as a part of the outline and in points at least; steps of a quarter arc, five points at least.
ARC, ARC_LEAST, STEP_LEAST = 0.30, 30, 5
#: Part of the expected area that an arc's ellipse may be off.
OFF = 0.50

_POINTS = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def split_basins(sized: DataFrame, expected_area: float, factor: float = MERGED, apart: int = APART, depth: float = DEPTH, chains: bool = True) -> DataFrame:
    """Outlines of more than ``factor`` animals' area parted where they are narrow; measured anew, with their ``part``.

    An outline with fewer than two basins is cut across its long axis, or with ``chains`` off stays whole. A basin loses
    the pixels along the lines where it meets another or the ground. Basins are read twice and so are kept as a table.
    """
    keys = [*IMAGE, "blob"]
    big = sized.filter(F.col("area_px") > factor * expected_area)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            which, part, points = [], [], []
            for i, outline in enumerate(batch.column("points").to_pylist()):
                for k, basin in enumerate(basins([(p["x"], p["y"]) for p in outline], apart, depth, LEAST_POINTS)):
                    which.append(i)
                    part.append(k)
                    points.append([{"x": x, "y": y} for x, y in basin])
            own = batch.select(keys).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(part, pa.int32()), pa.array(points, _POINTS)], names=[*keys, "part", "points"])

    parted = big.select(*keys, "points").mapInArrow(run, f"{_kinds(sized, keys)}, part int, points array<struct<x:int,y:int>>")
    parted = keep(parted, "basins")
    whole = big.join(parted.select(*keys).distinct(), keys, "left_anti")
    rest = split_chains(whole, expected_area, factor) if chains else whole.withColumn("part", F.lit(0))
    small = sized.filter(F.col("area_px") <= factor * expected_area).withColumn("part", F.lit(0))
    columns = [*small.columns]
    return small.unionByName(measured(parted).select(columns)).unionByName(rest.select(columns))


def arcs(found: DataFrame) -> DataFrame:
    """Each outline as a whole and, where it is long enough, windows sliding along it: image, blob, arc (0 is the whole), points."""
    n = F.size("points")
    length = F.greatest(F.lit(ARC_LEAST), F.floor(ARC * n).cast("int"))
    step = F.greatest(F.lit(STEP_LEAST), F.floor(length / 4).cast("int"))
    starts = F.when((n >= 2 * ARC_LEAST) & (length < n), F.sequence(F.lit(0), n - length, step)).otherwise(F.array().cast("array<int>"))
    windows = F.concat(F.array("points"), F.transform(starts, lambda i: F.slice("points", i + 1, length)))
    return found.filter(n >= LEAST_POINTS).select(*IMAGE, "blob", F.posexplode(windows).alias("arc", "points"))


def fitted(pieces: DataFrame) -> DataFrame:
    """The ellipse of each arc that has one: cx_px, cy_px, axes, orientation_deg, area_px, perimeter_px."""
    keys = [*IMAGE, "blob", "arc"]
    names = ["cx_px", "cy_px", "major_axis_px", "minor_axis_px", "_short"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            fits = [fit(np.array([(p["x"], p["y"]) for p in a], float)) for a in batch.column("points").to_pylist()]
            own = batch.select(keys).take(pa.array([i for i, f in enumerate(fits) if f], pa.int64()))
            values = [pa.array([f[k] for f in fits if f], pa.float64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*own.columns, *values], names=[*keys, *names])

    out = pieces.mapInArrow(run, f"{_kinds(pieces, keys)}, " + ", ".join(f"{n} double" for n in names))
    a, b = F.col("major_axis_px"), F.col("minor_axis_px")
    return out.withColumnRenamed("_short", "orientation_deg").withColumns({"area_px": ellipse_area(a, b), "perimeter_px": ellipse_perimeter(a, b), "solidity": F.lit(1.0)})


def rescued(detections: DataFrame, found: DataFrame, n_animals: int, expected_area: float, off: float = OFF) -> DataFrame:
    """Ellipses for the animals that a frame lacks, from arcs of all its outlines: those nearest to the expected area first.

    One that stands within an animal's radius of a detection or of one taken before is left out. Frames without any
    outline have no candidates. A frame's few candidates meet in one row.
    """
    low, high = expected_area * (1 - off), expected_area * (1 + off)
    r = suppression_radius(F.lit(max(1.0, expected_area)))
    candidates = fitted(arcs(found)).filter(F.col("area_px").between(low, high))
    columns = ["cx_px", "cy_px", "area_px", "perimeter_px", "solidity", "major_axis_px", "minor_axis_px", "orientation_deg"]
    row = F.struct(F.abs(F.col("area_px") - expected_area).alias("miss"), "blob", "arc", *columns)
    per_frame = candidates.groupBy(*IMAGE).agg(F.array_sort(F.collect_list(row)).alias("c"))
    centres = detections.groupBy(*IMAGE).agg(F.collect_list(F.struct("cx_px", "cy_px")).alias("held"))
    met = per_frame.join(centres, IMAGE, "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<cx_px:double,cy_px:double>>")))
    near = lambda a, b: F.hypot(a["cx_px"] - b["cx_px"], a["cy_px"] - b["cy_px"]) < r
    kind = met.schema["c"].dataType.simpleString()

    def step(taken: Column, c: Column) -> Column:
        full = F.size("held") + F.size(taken) >= n_animals
        close = F.exists("held", lambda h: near(h, c)) | F.exists(taken, lambda t: near(t, c))
        return F.when(full | close, taken).otherwise(F.array_append(taken, c))

    taken = met.select(*IMAGE, F.explode(F.aggregate("c", F.array().cast(kind), step)).alias("t"))
    return taken.select(*IMAGE, "t.blob", *[f"t.{c}" for c in columns])
