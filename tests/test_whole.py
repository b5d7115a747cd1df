"""Registered queries cover every track and frame of their tables."""

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import audit
from trackloom.plans import queries


def frame_of(n, track):
    return n + (n + track) // 5 + 4 * ((n + 3 * track) // 23)


def written_events(spark, root, users, n):
    """Users' events in order of time; of each four the first two meet at their events 12 and 33, others stay apart."""
    start = datetime.datetime(2024, 1, 1)
    at = lambda k, h: 10.0 + (3.0 if h in (12, 33) and k == 1 else 60.0 * k) + h % 3
    rows = [(i, start + datetime.timedelta(minutes=i), u, at(u % 4, h), '{"k": %d}' % (h % 4)) for i, (h, u) in enumerate(itertools.product(range(n), range(users)))]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double, props string")
    df.write.parquet(f"{root}/events.parquet")
    return str(root)


def test_queries_take_all_events(spark, tmp_path):
    sf_dir = written_events(spark, tmp_path, 12, 40)
    cells = {(f"r{u // 4}", u % 4, frame_of(h, u % 4)) for u in range(12) for h in range(40)}
    assert len(cells) == 12 * 40
    got = queries.audit_relabel(spark, sf_dir).collect()
    assert {(r.recording_id, r.original_track_id, r.frame_idx) for r in got} == cells and len(got) == len(cells)
    assert len({(r.recording_id, r.track_id, r.frame_idx) for r in got}) == len(cells)
    costs = queries.perm_costs(spark, sf_dir).groupBy("recording_id", "event_id").agg(F.count("*").alias("n"), F.min("perm_no").alias("a"), F.max("perm_no").alias("b"))
    assert {tuple(r) for r in costs.collect()} == {(f"r{k}", e, 24, 0, 23) for k in range(3) for e in ("14-0-1", "43-0-1")}


def test_listed_costs_by_scene(spark):
    """Scenes of 2 and 4 tracks: each lists its own permutations, as by the joined table of permutations."""
    rng, rows = np.random.default_rng(3), []
    for name, n in (("a", 2), ("b", 4)):
        for block, c, t in itertools.product(range(2), range(n), range(n)):
            rows.append((name, "m", block, c, t, None if c == 1 and block else float(rng.random()), None if (c, t, block) == (0, 1, 0) else float(rng.random())))
    edges = spark.createDataFrame(rows, "recording_id string, roi_label string, block int, col int, target int, cost double, jump_px double")
    key = lambda r: (r.recording_id, r.block, r.perm_no)
    got = {key(r): (r.cost, r.max_jump_px) for r in audit.listed_costs(edges).collect()}
    want = {}
    for s, n in (("a", 2), ("b", 4)):
        of = audit.permutation_costs(edges.filter(F.col("recording_id") == s), audit.permutations(spark, n))
        want |= {key(r): (pytest.approx(r.cost), r.max_jump_px) for r in of.collect()}
    assert len(got) == 2 * (2 + 24) and got == want
