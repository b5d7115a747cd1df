"""Runs of pixels of one image, (y, x0, x1) in order: touching runs, holes, and the border of a set."""

from __future__ import annotations

Run = tuple[int, int, int]

#: Sides of a pixel, and for each the border's next pixel and side, clockwise: round the far corner, straight on.
TOP, RIGHT, BOTTOM, LEFT = range(4)
AHEAD = {
    TOP: ((-1, 1, LEFT), (0, 1, TOP)), RIGHT: ((1, 1, TOP), (1, 0, RIGHT)), BOTTOM: ((1, -1, RIGHT), (0, -1, BOTTOM)), LEFT: ((-1, -1, BOTTOM), (-1, 0, LEFT)),
}


def connected(runs: list[Run], reach: int) -> list[int]:
    """For each run the first run of its set; runs of neighbouring rows touch when they overlap, or come within ``reach`` columns."""
    parent = list(range(len(runs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above = 0
    for i, (y, x0, x1) in enumerate(runs):
        while above < i and (runs[above][0] < y - 1 or (runs[above][0] == y - 1 and runs[above][2] < x0 - reach)):
            above += 1
        k = above
        while k < i and runs[k][0] == y - 1 and runs[k][1] <= x1 + reach:
            a, b = root(k), root(i)
            parent[max(a, b)] = min(a, b)
            k += 1
    return [root(i) for i in range(len(runs))]


def ground(runs: list[Run]) -> list[Run]:
    """What the runs leave of their box, widened by a pixel on each side."""
    left, right = min(r[1] for r in runs) - 1, max(r[2] for r in runs) + 1
    rows: dict[int, list[Run]] = {}
    for r in runs:
        rows.setdefault(r[0], []).append(r)
    out = []
    for y in range(runs[0][0] - 1, runs[-1][0] + 2):
        start = left
        for _, x0, x1 in rows.get(y, []):
            if start < x0:
                out.append((y, start, x0 - 1))
            start = x1 + 1
        if start <= right:
            out.append((y, start, right))
    return out


def filled(runs: list[Run]) -> list[Run]:
    """The runs with their holes; whatever lies inside a hole is a part of what surrounds it."""
    if not runs:
        return []
    outside = ground(runs)
    holes = [r for r, first in zip(outside, connected(outside, 0)) if first]
    out: list[Run] = []
    for y, x0, x1 in sorted(runs + holes):
        if out and out[-1][0] == y and out[-1][2] >= x0 - 1:
            out[-1] = (y, out[-1][1], x1)
        else:
            out.append((y, x0, x1))
    return out


def blobs(runs: list[Run]) -> list[list[Run]]:
    """Sets of runs that touch along sides or at corners, in order of their first runs."""
    sets: dict[int, list[Run]] = {}
    for r, first in zip(runs, connected(runs, 1)):
        sets.setdefault(first, []).append(r)
    return [sets[k] for k in sorted(sets)]


def border(runs: list[Run]) -> list[tuple[int, int]]:
    """The pixels (x, y) of a connected set's outer border in order, from its first one, downwards first.

    A pixel that the border passes twice stands there twice.
    """
    inside = {(y, x) for y, x0, x1 in runs for x in range(x0, x1 + 1)}
    start = at = (runs[0][0], runs[0][1], TOP)
    walk = []
    while True:
        walk.append(at[:2])
        y, x, side = at
        at = next(((y + dy, x + dx, s) for dy, dx, s in AHEAD[side] if (y + dy, x + dx) in inside), (y, x, (side + 1) % 4))
        if at == start:
            break
    turns = [p for p, before in zip(walk, [walk[-1], *walk]) if p != before] or walk[:1]
    # The walk begins at the first pixel's top and ends at its left side, so that pixel's turn is the last one.
    return [(x, y) for y, x in [turns[-1], *reversed(turns[:-1])]]


def simplified(points: list[tuple[int, int]], tolerance: float) -> list[tuple[int, int]]:
    """Corners of a closed outline that leave no point further from it than ``tolerance``, by splits at the farthest points.

    The first two corners are the point farthest from the outline's start, and the one farthest from that.
    """
    n = len(points)
    if n < 3:
        return points
    far = lambda i: max(range(n), key=lambda k: (points[k][0] - points[i][0]) ** 2 + (points[k][1] - points[i][1]) ** 2)
    a = far(0)
    ends = sorted((a, far(a)))
    kept, open_pieces = {*ends}, [(ends[0], ends[1]), (ends[1], ends[0] + n)]
    while open_pieces:
        i, j = open_pieces.pop()
        (x0, y0), (x1, y1) = points[i % n], points[j % n]
        length = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5

        def off(k: int) -> float:
            x, y = points[k % n]
            return abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / length if length else ((x - x0) ** 2 + (y - y0) ** 2) ** 0.5

        worst = max(range(i + 1, j), key=off, default=None)
        if worst is not None and off(worst) > tolerance:
            kept.add(worst % n)
            open_pieces += [(i, worst), (worst, j)]
    return [points[k] for k in sorted(kept)]
