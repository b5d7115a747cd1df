"""One merged outline parted into basins: depths, peaks, and a flood from the peaks over the pixels of its box."""

from __future__ import annotations

from collections import deque

import numpy as np

from .runs import blobs, border, connected, filled

Point = tuple[int, int]

#: Lengths of a step aside, a diagonal one and a knight's move, in ten thousandths of a pixel.
ASIDE, DIAGONAL, KNIGHT = 10_000, 14_000, 21_969
#: Free pixels around a blob's box: two belong to no side at first, one is ground for certain, one is the edge.
MARGIN = 4
LINE, WAITING, GROUND = -1, -2, 1


def pixels(points: list[Point], margin: int = MARGIN) -> tuple[np.ndarray, Point]:
    """The filled outline as a mask with a margin, and the place of the mask's corner."""
    x, y = np.array(points).T
    left, top = x.min() - margin, y.min() - margin
    mask = np.zeros((np.ptp(y) + 2 * margin + 1, np.ptp(x) + 2 * margin + 1), int)
    x, y = x - left, y - top
    lower = np.minimum(y, np.roll(y, -1))
    at = np.where(y <= np.roll(y, -1), x, np.roll(x, -1))
    np.add.at(mask, (lower[y != np.roll(y, -1)], at[y != np.roll(y, -1)]), 1)
    inside = np.cumsum(mask, axis=1) % 2 == 1
    inside[y, x] = True
    return inside, (int(left), int(top))


def runs_of(mask: np.ndarray) -> list[tuple[int, int, int]]:
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    return [(int(a[0]), int(a[1]), int(b[1]) - 1) for a, b in zip(np.argwhere(edge == 1), np.argwhere(edge == -1))]


def depths(mask: np.ndarray) -> np.ndarray:
    """Distance to the nearest place outside, in ten thousandths, by steps of three kinds."""
    h, w = mask.shape
    at = np.arange(w)
    before = np.maximum.accumulate(np.where(mask, -1, at), axis=1)
    after = np.minimum.accumulate(np.where(mask, w, at)[:, ::-1], axis=1)[:, ::-1]
    row = np.minimum(at - before, after - at)
    out = np.full((h, w), np.iinfo(np.int64).max)
    for dy in range(-(h - 1), h):
        dx, far = row[max(0, dy) : h + min(0, dy)], abs(dy)
        small, large = np.minimum(dx, far), np.maximum(dx, far)
        steps = np.where(large >= 2 * small, (large - 2 * small) * ASIDE + small * KNIGHT, (2 * small - large) * DIAGONAL + (large - small) * KNIGHT)
        here = slice(max(0, -dy), h - max(0, dy))
        out[here] = np.minimum(out[here], steps)
    return out


def highest(values: np.ndarray, reach: int) -> np.ndarray:
    """The greatest value of the square around each place."""
    for axis in (0, 1):
        padded = np.pad(values, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)])
        values = np.max([np.take(padded, range(k, k + values.shape[axis]), axis=axis) for k in range(2 * reach + 1)], axis=0)
    return values


def flood(inside: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Spread marks (1 and above) to places with 0 over sides, first come first served; where two meet stands a LINE.

    A step between inside and outside waits until all others are made. The outermost places are LINEs.
    """
    h, w = inside.shape
    marks = marks.copy()
    marks[[0, -1]] = marks[:, [0, -1]] = LINE
    mark, here = marks.ravel().tolist(), inside.ravel().tolist()
    sides = (-1, 1, -w, w)
    queues: tuple[deque, deque] = (deque(), deque())
    for i in range(w + 1, w * (h - 1) - 1):
        near = [here[i + s] != here[i] for s in sides if mark[i] == 0 and mark[i + s] > 0]
        if near:
            queues[min(near)].append(i)
            mark[i] = WAITING
    while queues[0] or queues[1]:
        i = (queues[0] or queues[1]).popleft()
        met = {mark[i + s] for s in sides if mark[i + s] > 0}
        mark[i] = met.pop() if len(met) == 1 else LINE
        if mark[i] > 0:
            for s in sides:
                if mark[i + s] == 0:
                    queues[here[i + s] != here[i]].append(i + s)
                    mark[i + s] = WAITING
    return np.array(mark).reshape(h, w)


def basins(points: list[Point], apart: int, depth: float, least_points: int) -> list[list[Point]]:
    """Outlines of the basins around the peaks of an outline, each peak deeper than ``depth`` and the highest within ``apart`` pixels; none if fewer than two."""
    inside, (left, top) = pixels(points)
    deep = depths(inside)
    peaks = runs_of((deep == highest(deep, apart)) & (deep > depth * ASIDE))
    firsts = connected(peaks, 1)
    names = {first: k for k, first in enumerate(sorted(set(firsts)), GROUND + 1)}
    if len(names) < 2:
        return []
    marks = np.where(highest(inside.astype(int), 2) == 0, GROUND, 0)
    for (y, x0, x1), first in zip(peaks, firsts):
        marks[y, x0 : x1 + 1] = names[first]
    flooded, out = flood(inside, marks), []
    for name in names.values():
        found = [border(b) for b in blobs(filled(runs_of(flooded == name)))]
        largest = max(found, key=enclosed, default=[])
        if len(largest) >= least_points and enclosed(largest) > 0:
            out.append([(x + left, y + top) for x, y in largest])
    return out if len(out) > 1 else []


def enclosed(points: list[Point]) -> float:
    """Area inside an outline."""
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2
