"""Assignments against all permutations."""

import itertools
import warnings

import numpy as np
import pytest

from trackloom.functions.assignment import assign, cheapest_other, ranked
from trackloom.operators import audit


def listed(motion, look, possible):
    """Costs of all permutations but the identity, infinite where a pair isn't possible."""
    n = len(motion)
    perms = np.array(list(itertools.permutations(range(n))))[1:]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        parts = [np.nan_to_num(np.nanmean(m[np.arange(n), perms], axis=1)) for m in (motion, look)]
    return perms, np.where(possible[np.arange(n), perms].all(axis=1), sum(parts), np.inf)


@pytest.mark.parametrize("n,trials", [(2, 30), (3, 60), (5, 120), (7, 20), (9, 5)])
def test_two_means_against_all_permutations(n, trials):
    """Rows without motion, rows, columns and pairs without looks, pairs that aren't possible."""
    rng = np.random.default_rng(n)
    for trial in range(trials):
        motion = rng.random((n, n)) * 50 + 100 * (1 - np.eye(n)) * (trial % 2)
        motion[rng.random(n) < 0.15 * (trial % 3)] = np.nan
        look = rng.random((n, n)) * rng.choice([1, 30, 200])
        look[rng.random(n) < 0.3] = np.nan
        look[:, rng.random(n) < 0.3] = np.nan
        if trial % 4 == 0:
            look[rng.random((n, n)) < 0.3] = np.nan
        possible = rng.random((n, n)) < rng.choice([1, 0.8, 0.5])
        perms, costs = listed(motion, look, possible)
        found = cheapest_other(motion, look, possible)
        if not np.isfinite(costs.min()):
            assert found is None
        else:
            assert found[0] == pytest.approx(costs.min()) == costs[(perms == found[1]).all(axis=1)][0]


def test_ranked_lists_all_by_rising_cost():
    rng = np.random.default_rng(1)
    cost, possible = rng.random((4, 4)) - 0.5, rng.random((4, 4)) < 0.9
    got = list(ranked(cost, possible))
    want = sorted(cost[range(4), p].sum() for p in itertools.permutations(range(4)) if possible[range(4), p].all())
    assert [c for c, _ in got] == pytest.approx(want) and len({tuple(p) for _, p in got}) == len(want)
    assert list(assign(np.array([[4.0, 1, 3], [2, 0, 5]]))) in ([1, 0], [2, 1])


def test_of_equal_costs_the_first():
    """Tracks without any cost of their own tie; the first permutation in order is taken, and one that costs as much as none isn't a swap."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        parts = np.full((5, 5, 5), np.nan)
        parts[0], parts[1] = rng.random((5, 5)) * 250, np.round(rng.random((5, 5)) * 50)
        parts[1, rng.permutation(5)[:3]] = np.nan
        parts[2:] = np.where(rng.random((5, 5)) < 0.4, np.round(rng.random((5, 5)) * 9), np.nan)  # all three or none
        possible = parts[0] <= 200
        perms, costs = listed(parts[1], parts[2:].sum(axis=0), possible)
        n, tied, best, before, after = audit._solved(parts, True, 200.0, (1.0, 1.0, 1.0))
        assert tied and n == 5
        if best is not None:
            assert best == list(perms[np.flatnonzero(costs <= costs.min() * (1 + 1e-12))[0]]) and after[0] == pytest.approx(costs.min())
