"""Outlines, their measures and the detector, against pixels counted one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry
from trackloom.functions.runs import blobs, border, connected, filled, simplified
from trackloom.operators import detect, outlines


def runs_of(image):
    return [(y, x, x + next((k for k, v in enumerate(image[y, x:]) if not v), image.shape[1] - x) - 1) for y in range(image.shape[0]) for x in range(image.shape[1]) if image[y, x] and not (x and image[y, x - 1])]


def counted(runs):
    """Area, length and points by squares of four pixel centres."""
    inside = {(y, x) for y, a, b in runs for x in range(a, b + 1)}
    area = length = n = 0
    for y, x in {(y - dy, x - dx) for y, x in inside for dy in (0, 1) for dx in (0, 1)}:
        have = [(y + dy, x + dx) in inside for dy in (0, 1) for dx in (0, 1)]
        if sum(have) == 4:
            area += 1
        elif sum(have) == 3:
            area, length, n = area + 0.5, length + math.sqrt(2), n + 1
        elif sum(have) == 2 and have[0] == have[3]:
            length, n = length + 2 * math.sqrt(2), n + 2
        elif sum(have) == 2:
            length, n = length + 1, n + 1
    return area, length, max(n, 1)


def shoelace(points):
    after = points[1:] + points[:1]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, after))) / 2, sum(math.dist(a, b) for a, b in zip(points, after)), len(points)


def hull(points):
    """Area of the convex hull by a monotone chain."""
    points = sorted(set(points))
    if len(points) < 3:
        return 0.0
    half = lambda ps: [out := []] and [(_pop(out, p), out.append(p)) for p in ps] and out

    def _pop(out, p):
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
            out.pop()

    return shoelace(half(points)[:-1] + half(points[::-1])[:-1])[0]


def test_borders_by_counting():
    rng = np.random.RandomState(0)
    for _ in range(600):
        image = rng.rand(rng.randint(1, 9), rng.randint(1, 9)) < rng.choice([0.3, 0.5, 0.7, 0.9])
        for blob in blobs(filled(runs_of(image))):
            points = border(blob)
            assert shoelace(points) == pytest.approx(counted(blob)) and points[0] == (blob[0][1], blob[0][0])
    assert border([(0, 0, 2), (1, 0, 2), (2, 0, 2)]) == [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    ring = [(0, 0, 4), (1, 0, 0), (1, 4, 4), (2, 0, 0), (2, 2, 2), (2, 4, 4), (3, 0, 0), (3, 4, 4), (4, 0, 4)]
    assert len(blobs(filled(ring))) == 1 and counted(filled(ring))[0] == 16  # what lies in a hole belongs to the ring
    assert connected([(0, 0, 0), (1, 1, 1)], 0) == [0, 1] and connected([(0, 0, 0), (1, 1, 1)], 1) == [0, 0] and filled([]) == []


def table(spark, images):
    rows = [("r", k, int(y), int(x)) for k, image in enumerate(images) for y, x in zip(*np.nonzero(image))]
    return spark.createDataFrame(rows, "recording_id string, frame_idx long, y int, x int")


def test_measures(spark):
    rng = np.random.RandomState(3)
    images = [rng.rand(8, 9) < p for p in (0.4, 0.6, 0.8) for _ in range(12)]
    got = outlines.measured(outlines.outlines(table(spark, images))).collect()
    assert len(got) == sum(len(blobs(filled(runs_of(i)))) for i in images)
    for r in got:
        points = [tuple(p) for p in r.points]
        blob = blobs(filled(runs_of(images[r.frame_idx])))[r.blob]
        assert points == border(blob)
        assert (r.area_px, r.perimeter_px, r.n_points) == pytest.approx(counted(blob))
        assert r.solidity == pytest.approx(r.area_px / hull(points) if hull(points) else 1.0)


def ellipse(h, w, cx, cy, a, b, degrees):
    y, x = np.mgrid[:h, :w]
    t = math.radians(degrees)
    u, v = (x - cx) * math.cos(t) + (y - cy) * math.sin(t), (y - cy) * math.cos(t) - (x - cx) * math.sin(t)
    return (u / a) ** 2 + (v / b) ** 2 <= 1


def frames(spark, masks, level=220, dark=30):
    rows = [("r", k, [int(v) for v in np.where(m, dark, level).ravel()]) for k, m in enumerate(masks)]
    df = spark.createDataFrame(rows, "recording_id string, frame_idx long, gray array<int>")
    from trackloom.operators import raster

    px = raster.explode_frames(df, masks[0].shape[1])
    return px, px.select("recording_id", "y", "x").distinct().withColumn("bg", F.lit(level))


def test_detector(spark):
    """A tilted ellipse, two animals, one outside the arena, a square with a hole, areas beyond the gate, a bent shape of low solidity."""
    h = w = 100
    square = np.zeros((h, w), bool)
    square[30:51, 30:51] = True
    square[38:43, 38:43] = False
    bent = np.zeros((h, w), bool)
    bent[30:34, 30:60] = bent[30:60, 30:34] = True
    masks = [
        ellipse(h, w, 50, 50, 12, 5, 30), ellipse(h, w, 30, 40, 8, 4, 0) | ellipse(h, w, 70, 60, 8, 4, 90), ellipse(h, w, 4, 4, 3, 3, 0), square,
        ellipse(h, w, 50, 50, 2, 1, 0), ellipse(h, w, 50, 50, 40, 40, 0), bent,
    ]
    px, bg = frames(spark, masks)
    arena = [{"operation": "add", "geometry": geometry.circle(50, 50, 45)}]
    found = detect.detect_frames(px, bg, 25, 3, arena, 20, 3000)
    got = {}
    for r in found.collect():
        got.setdefault(r.frame_idx, []).append(r)
    assert sorted(got) == [0, 1, 3, 6]
    (one,) = got[0]
    assert abs(one.cx_px - 50) < 0.5 and abs(one.cy_px - 50) < 0.5 and one.orientation_deg == pytest.approx(120, abs=3) and one.solidity > 0.9
    assert one.major_axis_px == pytest.approx(24, abs=2) and one.minor_axis_px == pytest.approx(10, abs=2)
    assert sorted((round(r.cx_px), round(r.cy_px)) for r in got[1]) == [(30, 40), (70, 60)]
    assert got[3][0].area_px == pytest.approx(400, abs=4) and got[3][0].cx_px == pytest.approx(40)  # the hole counts; opening takes the corners
    assert got[6][0].solidity < 0.6
    kept = detect.detect_frames(px, bg, 25, 3, arena, 20, 3000, min_solidity=0.6, max_ratio=2.0)
    assert sorted({r.frame_idx for r in kept.collect()}) == [3]
    size = lambda **k: detect.detect_frames(px.filter("frame_idx = 0"), bg, 25, 3, arena, 20, 3000, **k).first().area_px
    assert size(erosions=1) < size() < size(dilations=2)


def test_merged_animals_are_cut(spark):
    pair = ellipse(60, 80, 28, 30, 10, 5, 0) | ellipse(60, 80, 46, 30, 10, 5, 0)
    single = ellipse(60, 80, 30, 30, 10, 5, 0)
    px, bg = frames(spark, [pair, single])
    got = detect.detect_frames(px, bg, 25, expected_area=150.0).orderBy("frame_idx", "cx_px").collect()
    assert [r.frame_idx for r in got] == [0, 0, 1]
    assert got[0].cx_px < 37 < got[1].cx_px and abs(got[0].area_px - got[1].area_px) < 12
    assert detect.detect_frames(px, bg, 25, expected_area=300.0).count() == 2
    tiny = outlines.gate_area(outlines.outlines(table(spark, [np.ones((2, 4), bool)])), 1)
    assert outlines.split_chains(tiny, 1.0).count() == 1  # too few points to cut
    assert outlines.outlines(table(spark, [np.ones((2, 2), bool)]).limit(0)).count() == 0


def apart(p, a, b):
    """Distance of a point from a line through two others."""
    length = math.dist(a, b)
    return abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / length if length else math.dist(p, a)


def test_simplified_outlines():
    rng = np.random.RandomState(5)
    for _ in range(60):
        for blob in blobs(filled(runs_of(rng.rand(12, 12) < 0.75))):
            points = border(blob)
            for tolerance in (0.5, 1.5):
                corners = simplified(points, tolerance)
                assert set(corners) <= set(points) and len(corners) <= len(points)
                if len(set(points)) == len(points) > 2:  # each point lies near the side between the corners around it
                    at = [points.index(c) for c in corners]
                    assert at == sorted(at)
                    for i, j in zip(at, [*at[1:], at[0] + len(points)]):
                        assert all(apart(points[k % len(points)], points[i], points[j % len(points)]) <= tolerance for k in range(i, j))
    assert simplified([(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)], 0.5) == [(0, 0), (0, 2), (2, 2), (2, 0)]


def test_regions_from_two_backgrounds(spark):
    def regions(discs, **how):
        image = np.zeros((80, 80), bool)
        for x, y, r in discs:
            image |= ellipse(80, 80, x, y, r, r, 0)
        rows = [("r", y, x, 220 if image[y, x] else 0, 0) for y in range(80) for x in range(80)]
        df = spark.createDataFrame(rows, "recording_id string, y int, x int, bg int, ref int")
        return detect.auto_regions(df.select("recording_id", "y", "x", "bg"), df.select("recording_id", "y", "x", F.col("ref").alias("bg")), **how).collect()

    (one,) = regions([(40, 40, 12)])
    assert (one.operation, one.label) == ("add", "auto") and 3 <= len(one.vertices) < 30
    assert len(regions([(20, 20, 6), (60, 60, 6)])) == 2 and regions([(40, 40, 1)]) == []
    (wide,) = regions([(40, 40, 6)], dilations=4, erosions=0)
    assert shoelace([tuple(v) for v in wide.vertices])[0] > math.pi * 36
    (kept,) = regions([(40, 40, 8), (10, 10, 6)], arena=[{"operation": "add", "geometry": geometry.circle(40, 40, 25)}])
    assert all(math.dist(v, (40, 40)) < 16 for v in kept.vertices)
