"""Pairs, events, audit, review, appearance, raster, tracking and sources."""

import colorsys
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.functions import kalman, patches, scalar
from trackloom.operators import appearance, audit, events, metrics, pairs, raster, review, tracking
from trackloom.plans.stages import Meta, Recording
from trackloom.schema import DETECTIONS, nan_to_null, require
from trackloom.sources import frames, paths, tables

COLS = "recording_id string, roi_label string, track_id int, frame_idx long, cx_smooth_px double, cy_smooth_px double, heading_deg double"


def scene(spark, rows):
    return spark.createDataFrame([(r[0], "_merged", *r[1:]) for r in rows], COLS)


def one(df, expr):
    return df.select(expr.alias("x")).first().x


def test_pairs(spark):
    df = scene(spark, [("r", 0, 0, 0.0, 0.0, 30.0), ("r", 1, 0, 30.0, 40.0, 30.0), ("r", 2, 0, None, 1.0, 30.0), ("r", 0, 1, 0.0, 0.0, 0.0), ("r", 1, 1, 1.0, 0.0, 180.0), ("s", 0, 0, 1.0, 1.0, 5.0)])
    assert [(r.frame_idx, r.track_i, r.track_j, r.distance_mm) for r in pairs.pairwise_distance(df, 10.0).orderBy("frame_idx").collect()] == [(0, 0, 1, 5.0), (1, 0, 1, 0.1)]
    nn = {(r.track_id, r.frame_idx): r.nn_mm for r in pairs.nearest_neighbour(df, 10.0).collect()}
    assert nn == {(0, 0): 5.0, (1, 0): 5.0, (2, 0): None, (0, 1): 0.1, (1, 1): 0.1, (2, 1): None}
    pol = {(r.recording_id, r.frame_idx): (r.polarisation, r.n_headings) for r in pairs.polarisation(df).collect()}
    assert pol["r", 0][0] == pytest.approx(1) and pol["r", 1][0] == pytest.approx(0, abs=1e-9) and pol["s", 0] == (None, 1)
    near = pairs.nearest_sample(df, 1.0, 0.0).filter("recording_id = 'r'").first()
    assert (near.track_id, near.frame_idx) == (1, 1)


def test_geometry(spark):
    df = spark.createDataFrame([(5.0, 5.0), (0.0, 5.0), (12.0, 5.0), (9.0, 9.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    box = g.rectangle((0, 0), (10, 10))
    assert [r.d for r in df.select(g.edge_distance(x, y, box).alias("d")).collect()] == [5.0, 0.0, -2.0, 1.0]
    assert [r.d for r in df.select(g.contains(x, y, box).alias("d")).collect()] == [True, True, False, True]
    hole = [{"operation": "add", "geometry": box}, {"operation": "subtract", "geometry": g.circle(9, 9, 2)}, {"operation": "add", "label": "c", "geometry": g.circle(12, 5, 1)}]
    assert [r.d for r in df.select(g.fold_regions(x, y, hole).alias("d")).collect()] == [True, True, True, False]
    assert [r.d for r in df.select(g.split_regions(x, y, hole).alias("d")).collect()] == [["roi_0"], ["roi_0"], ["c"], ["roi_0"]]
    with pytest.raises(ValueError):
        g.fold_regions(x, y, hole[1:])
    assert g.centre_and_inscribed_radius(box) == (5.0, 5.0, 5.0)
    w = df.select(g.pixel_to_world(x, y, (5, 5), 0.1, "left", "up").alias("w")).collect()
    assert [tuple(r.w) for r in w][2] == (pytest.approx(-0.7), pytest.approx(0.0))


def test_scalars(spark):
    df = spark.createDataFrame([("12-3-1", "[0, 2,1]", "1:02:03", "#ff8000")], "id string, p string, t string, c string")
    assert tuple(one(df, scalar.event_pair(F.col("id")))) == (3, 1)
    assert tuple(one(df, scalar.event_pair(F.lit("x-1")))) == (0, 1)
    for text, pair in (("-1-0-2", (0, 2)), ("100-0-1", (0, 1)), ("a-b-2-4", (2, 4)), ("7-x-1", (0, 1)), ("", (0, 1))):
        assert tuple(one(df, scalar.event_pair(F.lit(text)))) == pair
    assert one(df, scalar.event_id(F.lit(7), F.lit(3), F.lit(1))) == "7-1-3"
    assert one(df, scalar.int_list(F.col("p"))) == [0, 2, 1] and one(df, scalar.int_list(F.lit("1,x"))) is None
    assert one(df, scalar.parse_time(F.col("t"))) == 3723.0 and one(df, scalar.parse_time(F.lit("a"))) is None
    assert tuple(one(df, scalar.hex_channels(F.col("c")))) == (0, 128, 255)
    assert one(df, scalar.circular_distance(F.lit(350.0), F.lit(20.0))) == 30.0
    assert one(df, scalar.transition_cost(F.lit(0.0), F.lit(135.0), 90.0)) == 45.0
    assert one(df, scalar.ellipse_perimeter(F.lit(10.0), F.lit(10.0))) == pytest.approx(10 * math.pi)
    assert one(df, scalar.continuity_score(F.lit(12.0), F.lit(10.0))) == pytest.approx(0.2) and one(df, scalar.continuity_score(F.lit(1.0), F.lit(0.0))) == 0
    assert one(df, scalar.continuity_score(F.lit(1500.0), F.lit(1000.0))) == pytest.approx(0.5) and one(df, scalar.continuity_score(F.lit(0.0), F.lit(10.0))) == 1
    assert one(df, scalar.ellipse_perimeter(F.lit(40.0), F.lit(10.0))) == pytest.approx(85.784, abs=1e-3)
    assert one(df, scalar.improvement_ratio(F.lit(10.0), F.lit(4.0))) == pytest.approx(0.6)
    assert [one(df, scalar.improvement_ratio(F.lit(b), F.lit(a))) for b, a in ((0.0, 4.0), (10.0, math.nan), (math.inf, 1.0), (-2.0, 1.0))] == [0] * 4
    assert one(df, scalar.encode_permutation(F.array(F.lit(1), F.lit(0), F.lit(2)))) == "1,0,2" and one(df, scalar.encode_permutation(F.lit(None).cast("array<int>"))) == ""
    assert one(df, scalar.int_list(F.lit("1,0,2"))) == [1, 0, 2] and one(df, scalar.int_list(F.lit("1-0-2"))) is None and one(df, scalar.int_list(F.lit(" "))) is None
    assert one(df, scalar.review_status(F.lit(""), F.lit(True))) == "auto_swap" and one(df, scalar.review_status(F.lit(None), F.lit(None))) == "pending"
    assert one(df, scalar.strip_suffix(F.lit("a_x.csv"), "_x.csv", ".csv")) == "a" and one(df, scalar.clip_byte(F.lit(300.7))) == 255
    assert tuple(one(df, scalar.hex_channels(scalar.track_colour(F.lit(0))))) == (0, 94, 213)
    made = [r.c for r in spark.range(8, 200).select(scalar.track_colour(F.col("id")).alias("c")).collect()]
    assert made == ["#" + "".join(f"{int(c * 255):02x}" for c in colorsys.hsv_to_rgb((i * 0.61803398875) % 1.0, 0.7, 0.9)) for i in range(8, 200)]
    assert one(df, scalar.wrapped_radians(F.lit(math.pi))) == math.pi


def test_ranges_and_trims(spark):
    df, whole = spark.range(1), lambda v: F.lit(v).cast("double")
    shown = lambda lo, hi, total: one(df, scalar.clamp_range(F.lit(lo), F.lit(hi), F.lit(total)))
    assert [tuple(shown(*r)) for r in ((0, 0, 1000), (-50, 2000, 1000), (500, 400, 1000), (999, 0, 1000))] == [(0, 999), (0, 999), (500, 501), (999, 1000)]
    assert shown(0, 5, 0) is None
    assert [one(df, scalar.frame_fraction(F.lit(f), F.lit(1000))) for f in (0, 999, -100, 2000)] == [0, 1, 0, 1] and one(df, scalar.frame_fraction(F.lit(3), F.lit(1))) == 0
    window = F.struct(F.lit(200).alias("lo"), F.lit(300).alias("hi"))
    assert [one(df, scalar.clamp_frame(F.lit(f), window)) for f in (150, 250, 400)] == [200, 250, 300]
    for trim, want in (((100, 1, 60), (0.99, 1.0)), ((None, None, 60), (0.1, 0.9)), ((6, None, 60), (0.1, 0.9)), ((30, 20, 60), (0.5, 0.51)), ((3, 9, 0), (0.1, 0.9))):
        assert tuple(one(df, scalar.trim_fractions(*map(whole, trim)))) == pytest.approx(want)
    for trim, want in (((None, None, 60), (0, 1)), ((15, 45, 60), (0.25, 0.75)), ((70, 1, 60), (59.999 / 60, 1)), ((3, 9, 0), (0.1, 0.9))):
        assert tuple(one(df, scalar.trim_span(*map(whole, trim)))) == pytest.approx(want)
    assert tuple(one(df, scalar.zoom_window(F.lit(10), F.lit(13), 5))) == (9, 13) and tuple(one(df, scalar.zoom_window(F.lit(10), F.lit(10), 1))) == (9, 11)
    assert [one(df, scalar.raster_column(F.lit(f), 10, 110, 51)) for f in (9, 10, 60, 110, 111)] == [None, 0, 25, 50, None]
    both = lambda p: tuple(one(df, scalar.polarity_backgrounds(F.lit(p), whole(9), whole(2))))
    assert both("dark_on_light") == (9, 2) and both("light_on_dark") == (2, 9)
    with pytest.raises(Exception, match="unknown polarity"):
        both("other")


def test_kalman_decouples(spark):
    rng, noise = np.random.RandomState(0), kalman.Noise()
    seen = [(float(x), float(y)) if rng.rand() > 0.2 else (None, None) for x, y in np.cumsum(rng.randn(12, 2), axis=0)]
    f = np.array([[1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 0], [0, 0, 0, 1]], float)
    h, q, r = np.eye(2, 4), np.diag([0.25] * 4), np.eye(2)
    s, p = None, None
    for x, y in seen:
        if s is not None:
            s, p = f @ s, f @ p @ f.T + q
        if x is not None:
            if s is None:
                s, p = np.array([x, y, 0, 0]), np.diag([1.0, 1.0, 100.0, 100.0])
            else:
                gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
                s, p = s + gain @ (np.array([x, y]) - h @ s), (np.eye(4) - gain @ h) @ p
    df = spark.createDataFrame([(seen,)], "rows array<struct<x:double,y:double>>")
    got = one(df, kalman.replay(F.col("rows"), noise))
    assert np.allclose([got.x, got.y, got.vx, got.vy], s) and np.allclose([got.pxx, got.pxv, got.pvv], [p[0, 0], p[0, 2], p[2, 2]])


def swapped(spark, at=30, n=60, third=False):
    """Tracks that run straight and exchange their labels where they meet."""
    rows = []
    for i in range(n):
        up, down = 50 + i * 50 / 29 if i < at else 100 + (i - 29) * 50 / 29, 150 - i * 50 / 29 if i < at else 100 - (i - 29) * 50 / 29
        pair = (up, down) if i < at else (down, up)
        rows += [("r", k, i, 50.0 + i, pair[k], 0.0) for k in (0, 1)] + [("r", 2, i, 400.0, 400.0, 0.0)] * third
    return scene(spark, rows)


@pytest.mark.parametrize("third", [False, True])
def test_swap_is_undone(spark, third):
    out, log = audit.audit_tracks(swapped(spark, third=third), 10.0, 1.0, 20.0, ratio=0.9, max_jump_px=200.0)
    assert log.count() == 1 and log.first().verdict == "auto"
    end = {r.original_track_id: r.track_id for r in out.filter("frame_idx = 59").collect()}
    assert end == {0: 1, 1: 0} | ({2: 2} if third else {})
    assert out.filter("frame_idx < 20 and track_id <> original_track_id").count() == 0


def test_looks_undo_a_swap_that_motion_misses(spark):
    """Two tracks meet at rest and exchange labels; patches and shapes alone tell them apart."""
    rows, prints = [], []
    for i in range(60):
        for k in (0, 1):
            who = k if i < 30 else 1 - k
            gap = 40.0 if i < 29 or i > 31 else 4.0
            rows.append(("r", k, i, 100.0 + (gap if k else 0.0), 100.0 + i % 2, 0.0))  # a cost of exactly 0 is never audited
            prints.append(("r", "_merged", k, i, [10, 20, 30, 200 - 100 * who], 100.0 + 50 * who, 20.0 + 10 * who, 10.0, i % 5 > 0 and k == 0))
    df = scene(spark, rows)
    looks = spark.createDataFrame(prints, "recording_id string, roi_label string, track_id int, frame_idx long, patch array<int>, area_px double, major_axis_px double, minor_axis_px double, is_confident boolean")
    args = dict(fps=10.0, px_per_mm=1.0, contact_mm=10.0, ratio=0.9, max_jump_px=200.0)
    assert audit.audit_tracks(df, **args)[1].count() == 0
    out, log = audit.audit_tracks(df, **args, fingerprints=looks, weights=(1e4, 1.0, 1.0))
    r = log.first()
    assert log.count() == 1 and r.verdict == "auto" and r.perm == [1, 0]
    assert (r.cost_appearance_before, r.cost_appearance_after) == (pytest.approx(50.0), 0.0)
    assert r.cost_axis_before == pytest.approx((0.5 + 1 / 3) / 2) and r.cost_area_after == 0.0 and r.cost_area_before == pytest.approx((0.5 + 1 / 3) / 2)
    assert r.cost_before == pytest.approx(r.cost_kalman_before + 1e4 * r.cost_appearance_before + r.cost_axis_before + r.cost_area_before)
    assert {x.original_track_id: x.track_id for x in out.filter("frame_idx = 59").collect()} == {0: 1, 1: 0}
    assert audit.audit_tracks(df, **args, fingerprints=looks.filter("frame_idx < 3"))[1].count() == 0


def test_verdicts_rule(spark):
    df = swapped(spark)
    event = events.event_blocks(df, 10.0, 1.0, 20.0).first().event_id
    for verdict, moved, mounted in (("reject_swap", False, False), ("accept_swap", True, False), ("mount", False, True)):
        v = spark.createDataFrame([("r", "_merged", event, verdict)], "recording_id string, roi_label string, event_id string, verdict string")
        out, _ = audit.audit_tracks(df, 10.0, 1.0, 20.0, ratio=0.9, max_jump_px=200.0, verdicts=v)
        assert (out.filter("frame_idx = 59 and track_id <> original_track_id").count() > 0) == moved
        assert (out.filter("event_type = 'mount'").count() > 0) == mounted
        assert review.without_mounts(out).count() == out.count() - out.filter("event_type = 'mount'").count()


def test_three_cycle_direction(spark):
    df = scene(spark, [("r", t, i, 50.0 + 50 * t, 0.0, 0.0) for t in range(3) for i in range(4)])
    blocks = spark.createDataFrame([("r", "_merged", 0, 1)], "recording_id string, roi_label string, block long, frame_end long")
    decided = spark.createDataFrame([("r", "_merged", 0, "accept_swap", [1, 2, 0])], "recording_id string, roi_label string, block long, verdict string, perm array<int>")
    out = audit.relabel(df, decided, blocks, df.select("recording_id", "roi_label", "track_id").distinct()).filter("frame_idx = 3")
    assert {r.track_id: r.cx_smooth_px for r in out.collect()} == {0: 150.0, 1: 50.0, 2: 100.0}


def test_blocks_and_candidates(spark):
    rows = [("r", 0, i, 0.0, 0.0, 0.0) for i in range(40)] + [("r", 1, i, 3.0 if i in (10, 11, 30) else 500.0, 0.0, 0.0) for i in range(40)]
    got = events.detect_candidates(scene(spark, rows), 5.0, 1.0, 5.0, 50.0, gap=5).orderBy("frame_start").collect()
    assert [(r.frame_start, r.frame_end, r.source, r.n_frames) for r in got] == [(10, 12, "contact,jump", 3), (30, 31, "contact,jump", 2)]
    assert got[0].min_distance_px == 3.0 and got[0].max_jump_px == 497.0 and got[0].event_id == "10-0-1"


def test_review(spark):
    cand = spark.createDataFrame([("5-0-1", 5, 7, 0, 1, "contact", 3.0, 4.0, 3), ("5-0-1", 5, 8, 0, 1, "jump", 2.0, float("nan"), 3)], "event_id string, frame_start long, frame_end long, animal_a int, animal_b int, source string, min_distance_px double, max_jump_px double, n_frames int")
    log = spark.createDataFrame([(9, "9-0-2", -1, 9, "auto", 10.0, 4.0), (8, "5-0-1", 5, 7, "mount", 1.0, 1.0)], "frame_idx long, event_id string, frame_start long, frame_end long, verdict string, cost_before double, cost_after double")
    verd = spark.createDataFrame([("7-1-2", 7, 7, 1, 2, "mount", "t2"), ("7-1-2", 7, 7, 1, 2, "unknown", "t1")], "event_id string, frame_start long, frame_end long, animal_a int, animal_b int, verdict string, timestamp_iso string").withColumns({"reviewer": F.lit(""), "note": F.lit("")})
    got = {r.event_id: r for r in review.merge_review(cand, log, verd).collect()}
    assert (got["5-0-1"].frame_end, got["5-0-1"].min_distance_px, got["5-0-1"].max_jump_px, got["5-0-1"].status) == (7, 2.0, 4.0, "pending")
    assert (got["9-0-2"].frame_start, got["9-0-2"].animal_b, got["9-0-2"].status) == (0, 2, "auto_swap")
    assert got["7-1-2"].status == "mount" and got["5-0-1"].sources == "contact,jump,audit"
    assert review.latest_verdicts(verd).first().verdict == "mount"
    checked = spark.createDataFrame([("accept_swap", "1,0,2", 9, 5, 0, 0), ("accept_swap", "0,1", 1, 2, 0, 1), ("x", "", 1, 2, 0, 1), ("mount", "", 1, 2, 0, 1), ("mount", "", 1, 2, 1, 1)], "verdict string, permutation string, frame_start long, frame_end long, animal_a int, animal_b int")
    assert [(r.problem is None, r.frame_start, r.animal_b) for r in review.check_verdicts(checked).collect()] == [(True, 5, 1), (False, 1, 1), (False, 1, 1), (True, 1, 1), (False, 1, 1)]


def test_patches(spark):
    a = [50] * 4 + [200] * 4
    df = spark.createDataFrame([(1, a), (1, a[::-1]), (1, a)], "k int, patch array<int>")
    assert one(df, patches.flip_rmse(F.col("patch"), F.array(*[F.lit(x) for x in a]))) == 0
    rows = [r.patch for r in appearance.canonical_patches(spark.createDataFrame([([50, 200] * 2,), ([200, 50] * 2,)], "patch array<int>"), 2).collect()]
    assert rows == [[200, 50] * 2] * 2
    assert appearance.median_patch(df, ["k"]).first().patch == a


def test_raster(spark):
    fg = [(y, x) for y in range(10, 21) for x in range(5, 26) if (y - 15) ** 2 / 25 + (x - 15) ** 2 / 100 <= 1]
    rows = [("r", 0, y, x) for y, x in fg] + [("r", 1, 3, 3)] + [("r", 2, y + d, x) for d in (0, 30) for y, x in fg]
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    df = spark.createDataFrame(rows, "recording_id string, frame_idx long, y int, x int")
    labels = raster.label_blobs(df).select("frame_idx", "label").distinct()
    assert sorted(r.frame_idx for r in labels.collect()) == [0, 1, 2, 2]
    opened = {(r.y, r.x) for r in raster.morph_open(df.filter("frame_idx < 2"), 3).collect() if r.frame_idx == 1}
    assert opened == set() and raster.dilate(df.filter("frame_idx = 1"), 3).count() == 5
    assert raster.sample_frames(100, 3) == [10, 49, 89] and raster.sample_frames(100, 3, rounded=True) == [10, 50, 89]


def test_tracker_keeps_ids(spark):
    rng, rows = random.Random(0), []
    for i in range(40):
        order = [0, 1, 2]
        rng.shuffle(order)
        rows += [("r", "_merged", i, d, 10.0 * i + 5 if t == 0 else 400.0 - 8 * i if t == 1 else 200.0, 50.0 * t, 100.0, 40.0, t) for d, t in enumerate(order) if not (t == 2 and 10 <= i < 13)]
    df = spark.createDataFrame(rows, "recording_id string, roi_label string, frame_idx long, det_idx int, cx_px double, cy_px double, area_px double, perimeter_px double, true_id int")
    got = tracking.track_detections(df).groupBy("true_id").agg(F.countDistinct("track_id").alias("n")).collect()
    assert [r.n for r in got] == [1, 1, 1]
    fixed = tracking.track_detections(df, tracking.Settings(n_animals=2))
    assert fixed.select("track_id").distinct().count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from trackloom.streaming.tracker import track_stream

    rows = [("r", "_merged", i, 0, 5.0 * i, 0.0, 100.0, 40.0) for i in range(20)] + [("r", "_merged", i, 1, 300.0, 3.0 * i, 100.0, 40.0) for i in range(20)]
    df = spark.createDataFrame(rows, "recording_id string, roi_label string, frame_idx long, det_idx int, cx_px double, cy_px double, area_px double, perimeter_px double")
    for k, (lo, hi) in enumerate([(0, 9), (9, 20)]):
        df.filter(f"frame_idx >= {lo} and frame_idx < {hi}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        q = track_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")).writeStream.format("parquet")
        q.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    key = lambda d: sorted((r.frame_idx, r.det_idx, r.track_id) for r in d.collect())
    assert key(got) == key(tracking.track_detections(df))


def test_sources(spark, tmp_path):
    names = [f.split(" ")[0] for f in DETECTIONS.split(", ")]
    df = spark.createDataFrame([("r", i, None, 0, float(i), 1.23456, float("nan"), 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(3)], "recording_id string, " + DETECTIONS)
    assert nan_to_null(df).filter("x_mm is null").count() == 3
    path = tables.write_detections(df, str(tmp_path))
    back = tables.read_detections(spark, path)
    assert back.count() == 3 and set(names) <= set(back.columns)
    assert {(r.roi_label, r.cy_px, r.x_mm) for r in back.collect()} == {("_merged", 1.235, None)}
    with pytest.raises(ValueError):
        require(df, "nothing")
    assert tables.read_verdicts(spark, f"{tmp_path}/none.csv").count() == 0
    assert paths.stem_of(paths.path_of("/a/b.mp4", "verdicts")) == "b"
    with pytest.raises(ValueError):
        paths.swap_log_path("/a/out.csv")
    (tmp_path / "m_4x2.gray").write_bytes(bytes(range(8 * 5)))
    frames.register(spark)
    got = spark.read.format("grayframes").option("start", 1).option("every", 2).option("framesPerPartition", 2).load(f"{tmp_path}/*.gray").orderBy("frame_idx").collect()
    assert [(r.recording_id, r.frame_idx, r.gray[0]) for r in got] == [("m", 1, 8), ("m", 3, 24)]
    (tmp_path / "a.json").write_text('{"schema_version": 2}')
    with pytest.raises(Exception, match="another version"):
        tables.read_arena(spark, f"{tmp_path}/a.json").select("schema_version").collect()


def test_facade(spark):
    rows = [("r", "_merged", t, i, 100.0 + 5 * i * (1 - 2 * t), 100.0 + 20 * t, 0.0, 100.0, 20.0, 10.0) for t in (0, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "recording_id string, roi_label string, track_id int, frame_idx long, cx_px double, cy_px double, orientation_deg double, area_px double, major_axis_px double, minor_axis_px double")
    rec = Recording(df, Meta(10.0, 10.0, g.circle(100, 100, 200))).trim(0, 30).clean(max_gap=2)
    s = rec.summary().orderBy("track_id").collect()
    assert len(s) == 2 and s[0].n_frames == 30 and s[0].speed_median_mm_s == pytest.approx(5.0) and s[0].nn_mean_mm > 0
    assert metrics.occupancy(rec.df, (0, 0, 300, 300), 4).agg(F.sum("p")).first()[0] == pytest.approx(1)
