"""Window operators against literal loops."""

import math
import random

import numpy as np
import pytest

from trackloom.operators import clean, heading, metrics, seq

K = ["recording_id", "roi_label", "track_id"]


def track(spark, values, rec="r", **more):
    """One track's frames with a value each; several recordings never mix."""
    rows = [(rec, "_merged", 0, i, v) for i, v in enumerate(values)] + [("other", "_merged", 0, i, 1e6) for i in range(3)]
    return spark.createDataFrame(rows, "recording_id string, roi_label string, track_id int, frame_idx long, v double")


def column(df, name, rec="r"):
    return [r[name] for r in df.filter(f"recording_id = '{rec}'").orderBy("frame_idx").collect()]


@pytest.mark.parametrize("values,gap,want", [([1, None, None, 4, 5], 3, [1, 2, 3, 4, 5]), ([1, None, None, None, None, 6], 3, [1, None, None, None, None, 6]), ([None, 2, 3], 3, [None, 2, 3]), ([1, None], 3, [1, None])])
def test_gaps(spark, values, gap, want):
    df = track(spark, [None if v is None else float(v) for v in values])
    assert column(seq.interpolate_gaps(df, ["v"], gap), "v") == want


def test_outliers_alternate_inside_fast_runs(spark):
    rng = random.Random(1)
    xs = [0.0]
    for _ in range(300):
        xs.append(None if rng.random() < 0.1 else (xs[-1] or 0.0) + rng.choice([0, 1, 1, 40, -35]))
    df = track(spark, xs).withColumnRenamed("v", "cx_px")
    df = df.withColumn("cy_px", df["cx_px"] * 0)
    got = column(seq.flag_outliers(df, 10.0, 1.0), "outlier_rejected")
    want, last = [False] * len(xs), None
    for i, x in enumerate(xs):
        if x is None:
            continue
        if last is not None and last[1] is not None and abs(x - last[1]) / (i - last[0]) > 10:
            want[i], last = True, (i, None)  # a rejected sample is no base: the next is kept
        else:
            last = (i, x)
    assert got == want


def test_smoothing_keeps_polynomials(spark):
    hat = seq.hat_matrix(11, 3)
    assert np.allclose(hat[5] * 429, [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36])
    values = [0.5 * i**3 - 2 * i**2 + i for i in range(30)]
    got = column(seq.smooth(track(spark, values), {"v": "s"}, 11, 3), "s")
    assert np.allclose(got, values)
    rng = np.random.RandomState(0)
    noisy = list(np.sin(np.arange(40) / 5) + 0.3 * rng.randn(40))
    noisy[20] = None
    got = column(seq.smooth(track(spark, [None if v is None else float(v) for v in noisy]), {"v": "s"}, 7, 2), "s")
    h = seq.hat_matrix(7, 2)
    for lo, hi in ((0, 20), (21, 40)):
        part = np.array(noisy[lo:hi], float)
        want = [h[i] @ part[:7] if i < 3 else h[7 - len(part) + i] @ part[-7:] if i >= len(part) - 3 else h[3] @ part[i - 3 : i + 4] for i in range(len(part))]
        assert np.allclose(got[lo:hi], want)
    assert column(seq.smooth(track(spark, [1.0, 5.0, 2.0]), {"v": "s"}, 7, 2), "s") == [1.0, 5.0, 2.0]
    with pytest.raises(ValueError):
        seq.hat_matrix(4, 2)


def test_gradient_per_run(spark):
    got = column(seq.gradient(track(spark, [1.0, 2.0, 4.0, None, 7.0, None, 1.0, 3.0]), {"v": "g"}, 10.0), "g")
    assert got == [10.0, 15.0, 20.0, None, None, None, 20.0, 20.0]


def test_unwrap(spark):
    rng = np.random.RandomState(1)
    wrapped = list((np.cumsum(rng.randn(80)) + math.pi) % (2 * math.pi) - math.pi)
    got = column(seq.unwrap(track(spark, [float(x) for x in wrapped]), "v", "u"), "u")
    assert np.allclose(got, np.unwrap(wrapped))


def test_schmitt(spark):
    rng = random.Random(3)
    xs = [None if rng.random() < 0.1 else rng.random() * 4 for _ in range(200)]
    state, want = False, []
    for x in xs:
        state = True if x is not None and x > 2.5 else False if x is not None and x < 1 else state
        want.append(state)
    assert column(seq.schmitt(track(spark, xs), "v", 2.5, 1.0), "active") == want


def test_densify_and_sessions(spark):
    df = track(spark, [1.0] * 10).filter("frame_idx not in (3, 4, 7) or recording_id <> 'r'")
    assert column(seq.densify(df), "observed") == [True] * 3 + [False] * 2 + [True] * 2 + [False] + [True] * 2
    ranks = seq.frame_ranks(df)
    got = seq.sessionize(ranks.filter("rank in (0, 1, 4, 6) and recording_id = 'r'"), 2).orderBy("rank").collect()
    assert [r.block for r in got] == [0, 0, 1, 1]


def test_repeated_frames_are_refused(spark):
    df = track(spark, [1.0, 2.0])
    with pytest.raises(Exception, match="two rows for one frame"):
        seq.refuse_repeats(df.union(df)).collect()


def viterbi(cands, unary, penalty):
    """Literal two-state search."""
    def turn(a, b):
        d = (a - b) % 360
        d = min(d, 360 - d)
        return 0.0 if d <= 90 else (d - 90) / 90 * penalty

    cost, back = list(unary[0]), []
    for i in range(1, len(cands)):
        new, frm = [], []
        for k in (0, 1):
            options = [cost[j] + turn(cands[i][k], cands[i - 1][j]) for j in (0, 1)]
            j = 1 if options[1] < options[0] else 0
            frm.append(j)
            new.append(options[j] + unary[i][k])
        cost = new
        back.append(frm)
    k = 1 if cost[1] < cost[0] else 0
    path = [k]
    for frm in reversed(back):
        k = frm[k]
        path.append(k)
    return path[::-1]


def test_two_state_path():
    rng = np.random.RandomState(2)
    for _ in range(60):
        n = 50
        theta = rng.randint(0, 180, n).astype(float)
        cands = [(t, (t + 180) % 360) for t in theta]
        unary = rng.randint(0, 180, (n, 2)).astype(float)
        unary[rng.rand(n) < 0.5] = 0
        turn = lambda a, b: max(0.0, min((a - b) % 360, (b - a) % 360) - 90)
        stay = np.array([0.0] + [turn(theta[i], theta[i - 1]) for i in range(1, n)])
        other = np.array([0.0] + [turn(theta[i] + 180, theta[i - 1]) for i in range(1, n)])
        assert heading.two_state_path(unary[:, 0] - unary[:, 1], stay, other).tolist() == viterbi(cands, unary, 90.0)


def test_walker_looks_ahead(spark):
    rows = [("r", "_merged", 0, i, 5.0 * i, 0.0, 15.0, 0.0, 15.0, 0.0 if i % 2 else 179.9) for i in range(30)]
    df = spark.createDataFrame(rows, "recording_id string, roi_label string, track_id int, frame_idx long, cx_smooth_px double, cy_smooth_px double, vx_mm_s double, vy_mm_s double, speed_mm_s double, orientation_deg double")
    out = heading.add_yaw(heading.resolve_headings(df), 30.0)
    assert all(min(h, 360 - h) < 1 for h in column(out, "heading_deg"))
    assert not any(column(out, "heading_unresolved")) and all(abs(y) < 400 for y in column(out, "yaw_rate_deg_s"))


def test_teleport_is_cleaned(spark):
    rows = [("r", "_merged", 0, i, 5000.0 if i == 10 else float(i), 0.0) for i in range(40) if i != 20]
    df = spark.createDataFrame(rows, "recording_id string, roi_label string, track_id int, frame_idx long, cx_px double, cy_px double")
    out = clean.clean_tracks(df, 30.0, 10.0)
    got = {r.frame_idx: r for r in out.collect()}
    assert got[10].outlier_rejected and not got[10].interpolated and got[20].interpolated
    assert all(abs(got[i].cx_smooth_px - i) < 1e-6 for i in range(40))
    assert got[5].speed_mm_s == pytest.approx(3.0)


def test_speed_summary(spark):
    df = track(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 10.0, None]).withColumnRenamed("v", "speed_mm_s").filter("recording_id = 'r'")
    r = metrics.speed_summary(df, 10.0).first()
    assert (r.speed_median_mm_s, r.speed_p90_mm_s, r.speed_max_mm_s, r.path_length_mm) == (3.5, 7.5, 10.0, 2.5)


def test_bouts(spark):
    v = [0, 3, 2, 2, 0.5, 0, 3, 0.5] + [3] * 5
    df = track(spark, [float(x) for x in v]).withColumnRenamed("v", "speed_mm_s").filter("recording_id = 'r'")
    got = [(r.frame_start, r.frame_end) for r in metrics.bouts(df, 10.0, 2.5, 1.0, 0.2).orderBy("frame_start").collect()]
    assert got == [(1, 3), (8, 12)]
    s = metrics.bout_summary(df, metrics.bouts(df, 10.0, 2.5, 1.0, 0.2), 10.0).first()
    assert s.n_walk_bouts == 2 and s.walking_time_s == pytest.approx(0.8)
