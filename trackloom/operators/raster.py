"""Image-plane operators over pixel tables: ``recording_id, frame_idx, y, x, v``.

Pixels meet their neighbours by spreading each pixel over the places it touches and aggregating
there, so frames of any number share one plan. Blobs are connected sets of foreground pixels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import few
from ..functions.geometry import fold_regions
from ..functions.runs import connected
from ..functions.scalar import saturating_subtract
from ..schema import FRAME

IMAGE = ["recording_id", FRAME]


def explode_frames(frames: DataFrame, width: int) -> DataFrame:
    """Pixel table of frames stored as row-major arrays ``gray``."""
    px = frames.select(*IMAGE, F.posexplode("gray").alias("pos", "v"))
    return px.select(*IMAGE, F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).alias("x"), F.col("v").cast("int").alias("v"))


def sample_frames(total: int, n: int, start: float = 0.1, end: float = 0.9, rounded: bool = False) -> list[int]:
    """Evenly spaced frame numbers between two parts of a recording, cut or rounded to whole ones."""
    if total <= 0 or n <= 0 or not 0 <= start < end <= 1:
        raise ValueError("an empty sample")
    lo, hi = int(total * start), max(int(total * start), int(total * end) - 1)
    place = (lambda i: lo + (hi - lo) * i / (n - 1)) if n > 1 else (lambda i: lo)
    return sorted({round(place(i)) if rounded else int(place(i)) for i in range(n)})


def sample_positions(total: Column, n: int, start: float = 0.1, end: float = 0.9, rounded: bool = False) -> Column:
    """As ``sample_frames``, for a column of lengths: an array of frame numbers."""
    if n < 2 or not 0 <= start < end <= 1:
        raise ValueError("an empty sample")
    lo = F.floor(total * start)
    hi = F.greatest(lo, F.floor(total * end) - 1)
    whole = F.bround if rounded else F.floor
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: whole(lo + (hi - lo) * i / (n - 1)).cast("bigint")))


def projections(pixels: DataFrame) -> DataFrame:
    """Brightest and darkest value of each pixel over the frames, in one pass."""
    return pixels.groupBy("recording_id", "y", "x").agg(F.max("v").alias("v_max"), F.min("v").alias("v_min"))


def foreground(pixels: DataFrame, background: DataFrame, threshold: float, absolute: bool = False) -> DataFrame:
    """Pixels that differ from the background (recording_id, y, x, bg) by more than ``threshold``.

    By default only pixels darker than the background count.
    """
    met = pixels.join(background, ["recording_id", "y", "x"])
    diff = F.abs(F.col("bg") - F.col("v")) if absolute else saturating_subtract(F.col("bg"), F.col("v"))
    return met.filter(diff > threshold).select(*IMAGE, "y", "x")


def disc(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptical kernel of odd ``size``."""
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dx) <= (round(r * math.sqrt(max(0.0, 1 - (dy / r) ** 2))) if r else 0)]


def dilate(fg: DataFrame, size: int) -> DataFrame:
    """Every place that the kernel around some foreground pixel covers."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc(size)])
    spread = fg.withColumn("_o", F.explode(offsets))
    return spread.select(*IMAGE, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x")).distinct()


def erode(fg: DataFrame, size: int) -> DataFrame:
    """Every place whose whole kernel is foreground."""
    n = len(disc(size))
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disc(size)])
    spread = fg.withColumn("_o", F.explode(offsets))
    places = spread.groupBy(*IMAGE, (F.col("y") - F.col("_o.dy")).alias("y"), (F.col("x") - F.col("_o.dx")).alias("x")).agg(F.count("*").alias("n"))
    return places.filter(F.col("n") == n).drop("n")


def morph_open(fg: DataFrame, size: int) -> DataFrame:
    return dilate(erode(fg, size), size)


def morph_close(fg: DataFrame, size: int) -> DataFrame:
    return erode(dilate(fg, size), size)


def masked(fg: DataFrame, regions: list[dict]) -> DataFrame:
    """Foreground inside regions that are added and subtracted in order."""
    return fg.filter(fold_regions(F.col("x").cast("double"), F.col("y").cast("double"), regions))


def mask_share(places: DataFrame, regions: list[dict]) -> DataFrame:
    """Pixels of each recording (recording_id, y, x) that a mask keeps, and their part."""
    kept = fold_regions(F.col("x").cast("double"), F.col("y").cast("double"), regions)
    return places.groupBy("recording_id").agg(F.count_if(kept).alias("kept_px"), (F.count_if(kept) / F.count("*")).alias("kept_share"))


def row_runs(fg: DataFrame) -> DataFrame:
    """Unbroken runs of foreground pixels in a row: y, x0, x1."""
    w = Window.partitionBy(*IMAGE, "y").orderBy("x")
    isle = fg.distinct().withColumn("_i", F.col("x") - F.row_number().over(w))
    return isle.groupBy(*IMAGE, "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i")


def label_blobs(fg: DataFrame) -> DataFrame:
    """Number the 8-connected blobs of each frame by their least (y, x) run. A frame's runs are labelled in one group."""
    frames = row_runs(fg).groupBy(*IMAGE).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            labels = []
            for found in batch.column("runs").to_pylist():
                runs = [(r["y"], r["x0"], r["x1"]) for r in found]
                labels.append([(*r, *runs[first][:2]) for r, first in zip(runs, connected(runs, 1))])
            image = batch.select(IMAGE).take(pa.array([i for i, rows in enumerate(labels) for _ in rows], pa.int64()))
            flat = [pa.array([row[k] for rows in labels for row in rows], pa.int32()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*image.columns, *flat], names=[*IMAGE, "y", "x0", "x1", "ly", "lx"])

    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in IMAGE)
    out = frames.mapInArrow(run, f"{kinds}, y int, x0 int, x1 int, ly int, lx int")
    return out.select(*IMAGE, "y", "x0", "x1", F.struct(F.col("ly").alias("y"), F.col("lx").alias("x0")).alias("label"))


def stamp_discs(centres: DataFrame, r: int) -> DataFrame:
    """The pixels that a round brush covers around each centre (recording_id, y, x), each once."""
    side = F.sequence(F.lit(-r), F.lit(r))
    spread = centres.withColumn("_dy", F.explode(side)).withColumn("_dx", F.explode(side)).filter(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") <= r * r)
    return spread.select("recording_id", (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x")).distinct()


def clone_disc(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int], r: int) -> DataFrame:
    """Copy a disc of pixels to another place."""
    dy, dx = target[1] - source[1], target[0] - source[0]
    inside = (F.col("x") - source[0]) * (F.col("x") - source[0]) + (F.col("y") - source[1]) * (F.col("y") - source[1]) <= r * r
    copied = pixels.filter(inside).select(*IMAGE, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("v").alias("_v"))
    return pixels.join(copied, [*IMAGE, "y", "x"], "left").withColumn("v", F.coalesce("_v", "v")).drop("_v")
