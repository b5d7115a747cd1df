import math
import random

import numpy as np
import pytest

from trackloom.llm import hard_negatives as hn
from trackloom.llm.hard_negatives import mine_hard_negatives, product

SCHEMA = "vec_id long, label int, embedding array<float>, score int, key string"


def plain(rows, every=10):
    """Rows by loops over all pairs."""
    known = set()
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            known.add((i, label, tuple(math.floor(256 * float(np.float32(v))) for v in x)))
    dot = lambda a, b: sum(p * q for p, q in zip(a[2], b[2]))
    out = []
    for a in known:
        if a[0] % every == 0:
            ranked = sorted((-dot(a, b), b[0], b) for b in known if b != a)
            for score, _, p in [r for r in ranked if r[2][1] == a[1]][:5]:
                met = [r for r in ranked if r[2][1] != a[1] and 80 * score >= 100 * r[0] >= 100 * score][:5]
                out += [(a[0], p[0], k, r[1], -score, -r[0]) for k, r in enumerate(met, 1)]
    return sorted(out)


def mined(spark, rows, every=10):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, mine_hard_negatives(df, every).collect()))


@pytest.mark.parametrize("anchors,side,dims", [(512, 2048, 32), (3, 40, 3)])
def test_by_brute_force(spark, monkeypatch, anchors, side, dims):
    """One label holds half of the rows; whole components make ties; tiles and chunks of several sizes."""
    for name, value in (("ANCHORS", anchors), ("ROWS", side), ("DIMENSIONS", dims)):
        monkeypatch.setattr(hn, name, value)
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 3]), [rng.choice([-1, 0, 1, 1, 2]) / 256 for _ in range(8)]) for i in range(150)]
    got = mined(spark, rows)
    assert got == plain(rows) and len({r[0] for r in got}) > 5


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    rows += [(60, None, [1.0] * 5), (70, 1, None), (80, 1, [1.0, None, 1.0, 1.0, 1.0]), (90, 1, [float("nan")] * 5), (100, 1, [float("inf")] * 5), (None, 1, [9.0] * 5)]
    rows += rows[:7] * 3  # repeated rows count once
    rows += [(110, 0, [1.0, 2.0]), (120, 1, []), (10, 2, [0.5] * 5)]  # short vectors; an id with two rows
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 2, [1.0])]) == []  # no positive


def test_products_are_exact():
    rng = np.random.RandomState(1)
    for most in (1000, 2**28):
        a, b = rng.randint(-most, most, (4, 30)), rng.randint(-most, most, (6, 30))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert product(a, b).tolist() == want
    tile = rng.randint(-(2**40), 2**40, (3, 7))
    assert hn._unpacked(hn._packed(tile), (3, 7)).tolist() == tile.tolist()
