"""Assignments of rows to columns: the cheapest, all of them by rising cost, and the cheapest by a sum of two means."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np

#: Halvings of the interval of a multiplier.
HALVINGS = 40


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest assignment (rows at most columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        short, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[col]:
            done[col] = True
            i = match[col]
            slack = cost[i - 1] - u[i] - v[1:]
            better = ~done[1:] & (slack < short[1:])
            short[1:][better] = slack[better]
            way[1:][better] = col
            nxt = int(np.argmin(np.where(done[1:], np.inf, short[1:]))) + 1
            delta = short[nxt]
            u[match[done]] += delta
            v[done] -= delta
            short[~done] -= delta
            col = nxt
        while col:
            match[col] = match[way[col]]
            col = way[col]
    out = np.zeros(n, int)
    for col in range(1, m + 1):
        if match[col]:
            out[match[col] - 1] = col - 1
    return out


def _solve(cost: np.ndarray, possible: np.ndarray) -> tuple[float, np.ndarray] | None:
    """The cheapest assignment of possible pairs, if there is one; costs may be negative."""
    rows = np.arange(len(cost))
    spread = np.max(cost, initial=0.0, where=possible) - np.min(cost, initial=0.0, where=possible)
    p = assign(np.where(possible, cost, np.max(cost, initial=0.0, where=possible) + 1 + 2 * len(cost) * spread))
    return (float(cost[rows, p].sum()), p) if possible[rows, p].all() else None


def ranked(cost: np.ndarray, possible: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """All assignments of possible pairs by rising cost: each one found parts the rest by its first pair that is not kept."""
    n, order = len(cost), count()
    first = _solve(cost, possible)
    heap = [(first[0], next(order), first[1], possible, 0)] if first else []
    while heap:
        total, _, p, allowed, fixed = heapq.heappop(heap)
        yield total, p
        for i in range(fixed, n):
            rest = allowed.copy()
            rest[i, p[i]] = False
            for k in range(fixed, i):
                rest[k] = False
                rest[k, p[k]] = True
            if found := _solve(cost, rest):
                heapq.heappush(heap, (found[0], next(order), found[1], rest, i))


def _least_with(cost: np.ndarray, marked: np.ndarray, possible: np.ndarray, k: int, below: float, but: np.ndarray) -> tuple[float, np.ndarray] | None:
    """The cheapest assignment of less than ``below`` with exactly k marked pairs, other than ``but``.

    A multiplier on marked pairs, found by halving, brings the unbound optimum near k of them; from there
    assignments come by rising cost, and the first that has k is the answer.
    """
    rows = np.arange(len(cost))
    span = 1 + 2 * len(cost) * float(np.abs(cost[possible]).max(initial=0.0))
    lo, hi, at = -span, span, 0.0
    for _ in range(HALVINGS):
        found = _solve(cost + at * marked, possible)
        if found is None:
            return None
        n = int(marked[rows, found[1]].sum())
        if n == k:
            break
        lo, hi = (at, hi) if n > k else (lo, at)
        at = (lo + hi) / 2
    for total, p in ranked(cost + at * marked, possible):
        if total - at * k >= below:
            return None
        if marked[rows, p].sum() == k and (p != but).any():
            return total - at * k, p
    return None


def cheapest_other(motion: np.ndarray, look: np.ndarray, possible: np.ndarray) -> tuple[float, np.ndarray] | None:
    """The cheapest permutation but the identity by its mean motion cost and its mean look cost; NaN where a pair has none.

    A row has motion costs for all possible pairs or for none, so that mean has one divisor; a mean over no pair is 0. Looks may be
    missing for any pair, so each number of pairs with looks is a problem of its own: the sum is then one of pairs. Exact for any number of tracks.
    """
    n, identity = len(motion), np.arange(len(motion))
    with_motion = (~np.isnan(motion) & possible).any(axis=1)
    marked, costs = ~np.isnan(look), np.nan_to_num(motion) / max(1, with_motion.sum())
    best: tuple[float, np.ndarray] | None = None
    most = min(marked.any(axis=1).sum(), marked.any(axis=0).sum())
    for k in range(most, -1, -1):
        of_k = costs + np.where(marked, np.nan_to_num(look), 0.0) / max(1, k)
        allowed = possible if k else possible & ~marked
        below = best[0] if best else np.inf
        unbound = _solve(of_k, allowed)
        if unbound is None or unbound[0] >= below:
            continue
        found = _least_with(of_k, marked, allowed, k, below, identity)
        best = found or best
    return best
