"""Arena and region geometry as expressions over point columns.

A shape is a plain mapping: ``{"shape": "circle", "cx", "cy", "r"}``, or ``{"shape": "rectangle" or
"polygon", "vertices": [(x, y), ...]}``. Shapes are constants of a recording, so their vertices are
literals of the plan.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Shape = dict


def circle(cx: float, cy: float, r: float) -> Shape:
    if r <= 0:
        raise ValueError("a circle needs a positive radius")
    return {"shape": "circle", "cx": float(cx), "cy": float(cy), "r": float(r)}


def polygon(vertices: list[tuple[float, float]]) -> Shape:
    if len(vertices) < 3:
        raise ValueError("a polygon needs three vertices")
    return {"shape": "polygon", "vertices": [(float(x), float(y)) for x, y in vertices]}


def rectangle(p: tuple[float, float], q: tuple[float, float]) -> Shape:
    """The upright rectangle with these opposite corners, from the top left corner clockwise."""
    (x0, x1), (y0, y1) = sorted((float(p[0]), float(q[0]))), sorted((float(p[1]), float(q[1])))
    if x0 == x1 or y0 == y1:
        raise ValueError("a rectangle needs an area")
    return {"shape": "rectangle", "vertices": [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]}


def origin_candidates(shape: Shape) -> list[tuple[str, tuple[float, float]]]:
    """Named points that a world frame may start from."""
    if shape["shape"] == "circle":
        cx, cy, r = shape["cx"], shape["cy"], shape["r"]
        return [("centre", (cx, cy)), ("east", (cx + r, cy)), ("north", (cx, cy - r)), ("west", (cx - r, cy)), ("south", (cx, cy + r))]
    return [(f"vertex {i}", v) for i, v in enumerate(shape["vertices"])]


def edge_length(p: tuple[float, float], q: tuple[float, float]) -> float:
    return math.hypot(p[0] - q[0], p[1] - q[1])


def box_edges(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Edges of upright rectangles, as ``rectangle`` orders them: array of (name, x, y, length), each from its first corner on."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    ends = [*corners[1:], corners[0]]
    return F.array(*[F.struct(F.lit(str(i)).alias("name"), p[0].alias("x"), p[1].alias("y"), F.hypot(p[0] - q[0], p[1] - q[1]).alias("length")) for i, (p, q) in enumerate(zip(corners, ends))])


def circle_origins(cx: Column, cy: Column, r: Column) -> Column:
    """The points of circles that a world frame may start from, as ``origin_candidates`` names them: array of (name, x, y)."""
    places = {"centre": (cx, cy), "east": (cx + r, cy), "north": (cx, cy - r), "west": (cx - r, cy), "south": (cx, cy + r)}
    return F.array(*[F.struct(F.lit(n).alias("name"), x.alias("x"), y.alias("y")) for n, (x, y) in places.items()])


def pixel_to_world(
    x: Column, y: Column, origin: tuple[float, float], mm_per_px: float, x_axis: str = "right", y_axis: str = "up"
) -> Column:
    """Struct (x_mm, y_mm). Pixel rows grow downwards, so an upward y axis turns y over."""
    sx, sy = (-1.0 if x_axis == "left" else 1.0), (-1.0 if y_axis == "up" else 1.0)
    return F.struct(
        ((x - origin[0]) * mm_per_px * sx).alias("x_mm"), ((y - origin[1]) * mm_per_px * sy).alias("y_mm")
    )


def _edges(shape: Shape) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    v = shape["vertices"]
    return list(zip(v, [*v[1:], v[0]]))


def _crossings(x: Column, y: Column, shape: Shape) -> Column:
    """Whether a ray to the right crosses the outline an odd number of times."""
    odd = F.lit(False)
    for (x0, y0), (x1, y1) in _edges(shape):
        if y0 != y1:
            straddles = (F.lit(y0) > y) != (F.lit(y1) > y)
            odd = odd != (straddles & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0))
    return odd


def _segment_distance(x: Column, y: Column, p: tuple[float, float], q: tuple[float, float]) -> Column:
    dx, dy = q[0] - p[0], q[1] - p[1]
    size = dx * dx + dy * dy
    if not size:
        return F.hypot(x - p[0], y - p[1])
    t = F.least(F.greatest(((x - p[0]) * dx + (y - p[1]) * dy) / size, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - (p[0] + t * dx), y - (p[1] + t * dy))


def edge_distance(x: Column, y: Column, shape: Shape) -> Column:
    """Pixels to the outline, positive inside, negative outside, 0 on it."""
    if shape["shape"] == "circle":
        return shape["r"] - F.hypot(x - shape["cx"], y - shape["cy"])
    each = [_segment_distance(x, y, p, q) for p, q in _edges(shape)]
    least = F.least(*each)
    return F.when(_crossings(x, y, shape), least).otherwise(-least)


def contains(x: Column, y: Column, shape: Shape) -> Column:
    """Whether the shape holds the point, its outline included."""
    if shape["shape"] == "circle":
        return (x - shape["cx"]) * (x - shape["cx"]) + (y - shape["cy"]) * (y - shape["cy"]) <= shape["r"] ** 2
    on_edge = reduce(lambda a, b: a | b, [_segment_distance(x, y, p, q) < 1e-9 for p, q in _edges(shape)])
    return _crossings(x, y, shape) | on_edge


def raster_shape(shape: Shape) -> Shape:
    """The shape as a raster draws it: polygon vertices cut to whole pixels."""
    if shape["shape"] == "circle":
        return shape
    return shape | {"vertices": [(float(int(x)), float(int(y))) for x, y in shape["vertices"]]}


def centre_and_inscribed_radius(shape: Shape) -> tuple[float, float, float]:
    """Circle: itself. Others: the vertices' mean and its distance to the outline."""
    if shape["shape"] == "circle":
        return shape["cx"], shape["cy"], shape["r"]
    v = shape["vertices"]
    cx, cy = sum(x for x, _ in v) / len(v), sum(y for _, y in v) / len(v)

    def away(p: tuple[float, float], q: tuple[float, float]) -> float:
        dx, dy = q[0] - p[0], q[1] - p[1]
        size = dx * dx + dy * dy
        t = min(1.0, max(0.0, ((cx - p[0]) * dx + (cy - p[1]) * dy) / size)) if size else 0.0
        return math.hypot(cx - p[0] - t * dx, cy - p[1] - t * dy)

    return cx, cy, min(away(p, q) for p, q in _edges(shape))


def fold_regions(x: Column, y: Column, regions: list[dict]) -> Column:
    """Whether a point is left after adding and subtracting regions in order.

    A region is ``{"operation": "add" or "subtract", "geometry": shape}``; the first must add. No
    regions hold nothing.
    """
    if regions and regions[0]["operation"] != "add":
        raise ValueError("the first region must add")
    inside = F.lit(False)
    for r in regions:
        here = contains(x, y, raster_shape(r["geometry"]))
        inside = (inside | here) if r["operation"] == "add" else (inside & ~here)
    return inside


def split_regions(x: Column, y: Column, regions: list[dict]) -> Column:
    """The labels of the adding regions that hold a point, each by itself; subtracting ones don't count."""
    labelled = [
        (r.get("label") or f"roi_{i}", contains(x, y, raster_shape(r["geometry"])))
        for i, r in enumerate(regions)
        if r["operation"] == "add"
    ]
    return F.filter(F.array(*[F.when(here, F.lit(label)) for label, here in labelled]), lambda v: v.isNotNull())
