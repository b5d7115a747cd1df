"""Merged animals parted into basins, and missing ones found on arcs, against plain loops."""

import math

import numpy as np
import pytest

from test_outlines import ellipse, frames, table
from trackloom.functions.basins import LINE, basins, depths, enclosed, flood, highest, pixels, runs_of
from trackloom.functions.ellipses import fit
from trackloom.functions.runs import blobs, border, filled
from trackloom.operators import detect, outlines, separate


def drawn(mask):
    return border(blobs(filled(runs_of(mask)))[0])


def test_depths_and_peaks_by_plain_loops():
    rng = np.random.RandomState(0)

    def length(a, b):
        small, large = sorted((a, b))
        return (large - 2 * small) * 10_000 + small * 21_969 if large >= 2 * small else (2 * small - large) * 14_000 + (large - small) * 21_969

    for _ in range(15):
        mask = np.pad(rng.rand(8, 11) < 0.8, 2)
        got, outside = depths(mask), np.argwhere(~mask)
        for y, x in np.argwhere(mask):
            assert got[y, x] == min(length(abs(y - a), abs(x - b)) for a, b in outside)
        top = highest(got, 2)
        assert all(top[y, x] == got[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].max() for y, x in np.ndindex(*mask.shape))


def test_masks_of_outlines():
    rng = np.random.RandomState(1)
    for _ in range(60):
        for blob in blobs(filled(runs_of(rng.rand(9, 9) < 0.7))):
            mask, (left, top) = pixels(border(blob))
            assert {(y + top, x + left) for y, x in np.argwhere(mask)} == {(y, x) for y, a, b in blob for x in range(a, b + 1)}


def test_flood_keeps_nearer_places():
    """Each place belongs to a mark that reaches it in the fewest steps inside, but for lines where two meet."""
    inside = np.pad(ellipse(40, 60, 30, 20, 25, 15, 0), 4)
    marks = np.where(highest(inside.astype(int), 2) == 0, 1, 0)
    marks[24, 14], marks[24, 50] = 2, 3
    got = flood(inside, marks)
    # Places that lines cut off go to the ground.
    assert set(np.unique(got[inside])) <= {LINE, 1, 2, 3} and (got != 0).all() and (got[inside] == 1).mean() < 0.02
    for y, x in np.argwhere(inside & (got > 1)):
        near, far = abs(y - 24) + abs(x - 14), abs(y - 24) + abs(x - 50)
        assert got[y, x] == (2 if near < far else 3) or near == far


@pytest.mark.parametrize(
    "shapes,n",
    [
        ([(50, 60, 20, 20), (85, 60, 20, 20)], 2), ([(50, 60, 18, 18), (82, 60, 18, 18), (114, 60, 18, 18)], 3), ([(60, 60, 30, 30)], 0),
        ([(90, 100, 28, 12), (140, 100, 28, 12)], 2),
    ],
)
def test_touching_discs(shapes, n):
    mask = np.any([ellipse(160, 200, cx, cy, a, b, 0) for cx, cy, a, b in shapes], axis=0)
    points = drawn(mask)
    found = basins(points, 8, 2, 5)
    assert len(found) == n
    for k, basin in enumerate(sorted(found)):
        inside, (left, top) = pixels(basin)
        assert all(mask[y + top, x + left] for y, x in np.argwhere(inside))
        assert enclosed(basin) / enclosed(points) == pytest.approx(1 / n, abs=0.07)


def test_basins_of_many_frames(spark):
    two = ellipse(120, 140, 45, 60, 20, 20, 0) | ellipse(120, 140, 80, 60, 20, 20, 0)
    three = ellipse(120, 180, 40, 60, 18, 18, 0) | ellipse(120, 180, 72, 60, 18, 18, 0) | ellipse(120, 180, 104, 60, 18, 18, 0)
    bar = ellipse(120, 180, 90, 60, 40, 30, 0)
    found = outlines.gate_area(outlines.outlines(table(spark, [two, three, bar, two])), 20, 1e6)
    size = {r.frame_idx: r.area_px for r in found.collect()}
    by = lambda df: {k: [r.frame_idx for r in df.collect()].count(k) for k in range(4)}
    assert by(separate.split_basins(found, size[0] / 2)) == {0: 2, 1: 3, 2: 2, 3: 2}  # the last shape has one peak and is cut across
    assert by(separate.split_basins(found, size[0] / 2, chains=False)) == {0: 2, 1: 3, 2: 1, 3: 2}
    assert by(separate.split_basins(found, 1e5)) == {k: 1 for k in range(4)}
    assert separate.split_basins(found.limit(0), 10.0).count() == 0


def test_fits():
    t = np.linspace(0, 2 * np.pi, 60)
    turn = np.array([[math.cos(0.5), -math.sin(0.5)], [math.sin(0.5), math.cos(0.5)]])
    for part in (60, 18):
        points = np.column_stack([20 * np.cos(t[:part]), 8 * np.sin(t[:part])]) @ turn.T + [50, 40]
        assert fit(points) == pytest.approx((50, 40, 40, 16, math.degrees(0.5) + 90), abs=1e-6)
    assert fit(np.array([[k, k] for k in range(6)], float)) is None and fit(np.array([[0, 0]] * 5, float)) is None


def test_arcs(spark):
    """A short outline is one arc; a long one has windows of three tenths, a quarter of that apart."""
    small, large = ellipse(40, 40, 20, 20, 5, 5, 0), ellipse(120, 120, 60, 60, 40, 30, 0)
    got = {}
    for r in separate.arcs(outlines.outlines(table(spark, [small, large]))).collect():
        got.setdefault(r.frame_idx, []).append([tuple(p) for p in r.points])
    assert len(got[0]) == 1
    whole = got[1][0]
    n = len(whole)
    window, step = max(30, int(0.3 * n)), max(5, max(30, int(0.3 * n)) // 4)
    assert whole == drawn(large) and got[1][1:] == [whole[i : i + window] for i in range(0, n - window + 1, step)]


def test_missing_animals(spark):
    """Two that overlap are one outline; arcs give the second. No more than are missing, none where all are there or none fits."""
    overlap = ellipse(120, 140, 50, 60, 24, 12, 0) | ellipse(120, 140, 84, 66, 24, 12, 40)
    one = ellipse(120, 140, 60, 60, 24, 12, 0)
    area = math.pi * 24 * 12
    found = outlines.measured(outlines.outlines(table(spark, [overlap, one])))
    none = found.filter("false")
    got = separate.rescued(none, found, 2, area).collect()
    of = lambda k: sorted((r.cx_px, r.cy_px) for r in got if r.frame_idx == k)
    assert len(of(0)) == 2 and math.dist(of(0)[0], (50, 60)) < 6 and math.dist(of(0)[1], (84, 66)) < 6
    assert len(of(1)) == 1 and math.dist(of(1)[0], (60, 60)) < 2  # another one nowhere
    assert all(abs(r.area_px - area) <= area / 2 and r.solidity == 1 for r in got)
    assert separate.rescued(found, found, 1, area).count() == 0
    assert separate.rescued(none, found, 1, area).groupBy("frame_idx").count().filter("count > 1").count() == 0
    assert separate.rescued(none, found, 2, 10 * area).count() == 0
    # the same by a plain loop over all candidates
    cands = [(abs(r.area_px - area), r.blob, r.arc, r.cx_px, r.cy_px) for r in separate.fitted(separate.arcs(found)).collect() if r.frame_idx == 0 and abs(r.area_px - area) <= area / 2]
    taken = []
    for c in sorted(cands):
        if len(taken) < 2 and all(math.dist(c[3:], t) >= math.sqrt(area / math.pi) for t in taken):
            taken.append(c[3:])
    assert np.allclose(of(0), sorted(taken))


def test_detector_with_splitter_and_rescue(spark):
    pair = ellipse(100, 120, 40, 50, 14, 14, 0) | ellipse(100, 120, 66, 50, 14, 14, 0)
    px, bg = frames(spark, [pair])
    assert detect.detect_frames(px, bg, 25, expected_area=600.0, n_animals=2).count() == 2
    assert detect.detect_frames(px, bg, 25).count() == 1
    tilted = ellipse(100, 120, 40, 50, 22, 10, 0) | ellipse(100, 120, 70, 56, 22, 10, 40)
    px, bg = frames(spark, [tilted])
    # below the splitter's area, so only the arcs tell them apart
    got = detect.detect_frames(px, bg, 25, max_area=900, expected_area=690.0, n_animals=2).collect()
    assert len(got) == 2 and sorted(r.det_idx for r in got) == [0, 1]
    with pytest.raises(ValueError):
        detect.detect_frames(px, bg, 25, splitter="other")
