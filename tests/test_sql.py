"""Queries give what their SQL gives where single and double precision, or the last bit, part them."""

import hashlib
import math
import random

import pyarrow as pa
import pytest

from trackloom.functions import batches, patches
from trackloom.operators import audit, outlines, pairs, raster, seq
from trackloom.plans import function_queries, oracle, queries
from trackloom.sources import scratch, tables
from trackloom.sources.adapters import patches_from_embeddings

#: Components whose greys are halves in single precision and less in double precision, with their greys.
HALVES = {0.16499993205070496: 145, 0.1449999362230301: 143, 0.03499995917081833: 132, -0.19500002264976501: 109}


@pytest.fixture
def vectors(spark, tmp_path):
    rows = [(i, [v] * 32 + [0.0] * 32, 1) for i, v in enumerate(HALVES)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_greys_are_made_in_single_precision(spark, vectors):
    df = spark.read.parquet(f"{vectors}/embeddings.parquet")
    assert {r.vec_id: r.patch[0] for r in patches_from_embeddings(df).collect()} == dict(enumerate(HALVES.values()))
    wide = df.selectExpr("vec_id", "cast(embedding as array<double>) as embedding", "label")
    assert {r.vec_id: r.patch[0] for r in patches_from_embeddings(wide).collect()} == dict(enumerate(HALVES.values()))


def test_patch_queries_see_these_greys(spark, vectors):
    greys = dict(enumerate(HALVES.values()))
    for query in (queries.patch_canonical, function_queries.fingerprint_table):
        assert {r.vec_id: max((int(v) for v in r.patch.split(",")), key=lambda v: abs(v - 128)) for r in query(spark, vectors).collect()} == greys
    cloned = function_queries.clone_patch(spark, vectors).filter("y = 0 and x = 0").collect()
    assert {r.frame_idx: r.v for r in cloned} == greys


def test_frame_clock_has_a_row_for_each_detection(spark, tmp_path):
    """Frames before 10 and after 100 too, two detections in one column as two rows."""
    times = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) as ts"
    spark.range(120).selectExpr("id as event_id", times, "5L as user_id", "1.0D as value", "'{\"k\": 3}' as props").write.parquet(f"{tmp_path}/events.parquet")
    rows = function_queries.frame_clock(spark, str(tmp_path)).orderBy("frame_idx").collect()
    frames = [r.frame_idx for r in rows]
    assert len(set(frames)) == 120 and frames[0] < 10 and frames[-1] > 100
    assert [r.strip for r in rows] == [int((f - frames[0]) / (frames[-1] - frames[0]) * 49) for f in frames]
    assert [r.at for r in rows] == [round(f / 2) for f in frames]


def tasks_of_stages(spark, run):
    """The numbers of tasks of the stages that ``run`` starts."""
    spark.sparkContext.setJobGroup("counted", "counted")
    run()
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("counted") for s in status.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("other", "other")
    return [info.numTasks for s in stages if (info := status.getStageInfo(s)) and info.numCompletedTasks]


def test_files_are_made_by_all_cores(spark, tmp_path):
    """A small table would be one task that makes file after file."""
    rows = spark.range(64).selectExpr("1 as schema_version", "id").repartition("id")
    assert tasks_of_stages(spark, lambda: tables.write_json(rows, f"file://{tmp_path}/json"))[-1] >= 4
    assert len(list(tmp_path.glob("json/v-*/*.json"))) == 64


def test_hashes_of_a_folder(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"in/r={k}").mkdir(parents=True)
        (tmp_path / f"in/r={k}/a.txt").write_text(f"{k}")
        (tmp_path / f"in/r={k}/b.csv").write_text("x")
    found = {r.path.split("r=")[1][0]: r.sha256 for r in tables.file_hashes(spark, f"file://{tmp_path}/in", "*.txt").collect()}
    assert found == {str(k): hashlib.sha256(f"{k}".encode()).hexdigest() for k in range(3)}


def test_decisions_are_made_by_all_cores(spark):
    """Blocks of many recordings, each decided in its group; the ordered swaps of a recording follow one another."""
    blocks = spark.range(40).selectExpr(
        "concat('r', id div 2) as recording_id", "'m' as roi_label", "id % 2 as block", "concat('e', id % 2) as event_id", "10 * (id % 2) as frame_start", "10 * (id % 2) + 2 as frame_end",
        "10 * (id % 2) + 3 as rank_start", "10 * (id % 2) + 5 as rank_end", "40L as rank_last", "id % 2 as place_a", "id % 2 + 1 as place_b",
    )
    edges = blocks.selectExpr("recording_id", "roi_label", "block", "explode(array(0, 1, 2)) as col").selectExpr("*", "explode(array(0, 1, 2)) as target", "1.0D as cost", "1.0D as jump_px")
    verdicts = blocks.selectExpr("recording_id", "roi_label", "event_id", "'accept_swap' as verdict")
    decided = audit.decide(edges, blocks, verdicts, 10.0, 0.9, 60)
    got = {}
    assert max(tasks_of_stages(spark, lambda: got.update({(r.recording_id, r.block): (r.perm, r.now, r.cost_before) for r in decided.collect()}))) >= 8
    assert got == {(f"r{k}", b): (([1, 0, 2], [1, 0, 2], None), ([0, 2, 1], [2, 0, 1], None))[b] for k in range(20) for b in range(2)}


def test_few_rows_become_python_objects_at_a_time():
    batch = pa.record_batch({"a": list(range(1001))})
    parts = list(batches.few([batch, batch.slice(0, 0), batch.slice(0, 5)]))
    assert [v for p in parts for v in p.column("a").to_pylist()] == [*range(1001), *range(5)] and max(p.num_rows for p in parts) == batches.ROWS


def test_enlarged_runs_trace_as_enlarged_pixels(spark):
    fg = spark.createDataFrame([("a", 1, y, x) for y, x in ((0, 0), (0, 1), (1, 1), (1, 3), (2, 2), (4, 0))], "recording_id string, frame_idx long, y int, x int")
    large = fg.selectExpr("recording_id", "frame_idx", "explode(sequence(0, 2)) as dy", "y", "x").selectExpr("*", "explode(sequence(0, 2)) as dx")
    by_pixels = outlines.outlines(large.selectExpr("recording_id", "frame_idx", "y * 3 + dy as y", "x * 3 + dx as x"))
    runs = raster.row_runs(fg).selectExpr("recording_id", "frame_idx", "explode(sequence(0, 2)) as dy", "y", "x0", "x1")
    by_runs = outlines.traced(runs.selectExpr("recording_id", "frame_idx", "y * 3 + dy as y", "x0 * 3 as x0", "(x1 + 1) * 3 - 1 as x1"))
    assert sorted(by_runs.collect()) == sorted(by_pixels.collect()) and by_runs.count() == 2


def test_lengths_and_weights_have_the_bits_of_sql(spark):
    rng = random.Random(1)
    rows = [("a", "m", t, f, rng.randrange(56000) / 100, rng.randrange(100) * 4.0) for f in range(2000) for t in (0, 1)]
    df = spark.createDataFrame(rows, "recording_id string, roi_label string, track_id int, frame_idx long, cx_smooth_px double, cy_smooth_px double")
    got = {r.frame_idx: r.distance_mm for r in pairs.pairwise_distance(df, 1.0).collect()}
    assert got == {a[3]: math.sqrt((a[4] - b[4]) * (a[4] - b[4]) + (a[5] - b[5]) * (a[5] - b[5])) for a, b in zip(rows[::2], rows[1::2])}
    for window, degree in oracle.FITS:
        assert seq.hat_matrix(window, degree).tolist() == oracle.FITS[window, degree]


def test_audit_reviewed_makes_its_tables_once(spark, tmp_path, monkeypatch):
    """The blocks that get verdicts are those that are audited, so the grid and the blocks are made and kept once."""
    events = spark.range(320).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts", "id % 8 as user_id", "cast(id % 37 * 12 as double) as value", "'{\"k\": ' || id % 50 || '}' as props",
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    names, plain = [], scratch.shared_dir
    monkeypatch.setattr(scratch, "shared_dir", lambda session, name: names.append(name) or plain(session, name))
    assert queries.audit_reviewed(spark, str(tmp_path)).count() == 320
    assert sorted(names) == ["blocks", "decided", "detections", "grid"]


def test_frames_of_missing_vectors_are_there(spark, tmp_path):
    """A row without a vector is a frame of unknown greys: black where it is cut out, a place in a running window, not a row less."""
    rows = [(i, None if i in (1, 3, 13) else [i / 100] * 64, 1) for i in range(15)] + [(16, None, 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    cut = {(r.frame_idx, r.track_id): r.patch for r in function_queries.pose_patches(spark, str(tmp_path)).collect()}
    assert len(cut) == 32 and all((set(p.split(",")) == {"0"}) == (f in (1, 3, 13, 16)) for (f, _), p in cut.items())
    assert function_queries.fingerprint_extract(spark, str(tmp_path)).count() == 32
    running = {(r.track_id, r.frame_idx): r.patch and r.patch.split(",")[0] for r in function_queries.running_patch(spark, str(tmp_path)).collect()}
    # Frames 0, 3, 6, 9 and 12 don't count; of the last nine others at frame 14 (2, 4, 5, 7, 8, 10, 11, 13, 14) one is unknown.
    assert running[1, 14] == "135.5" and running[1, 13] == "135.0" and running[1, 2] == "130.0"
    assert running[1, 1] is None and running[2, 16] is None and len(running) == 11


@pytest.fixture
def uneven(spark, tmp_path):
    """Vectors without components, with too few and with too many for a frame of 64, and a missing one."""
    rng = random.Random(2)
    sizes = (64, 0, 3, 64, 5, 12, 60, 60, 63, 64, 65, 72, 130, 130, 64, None, 64)
    rows = [(i, None if n is None else [rng.uniform(-1, 1) for _ in range(n)], 1) for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    greys = {r.vec_id: r.patch for r in patches_from_embeddings(spark.read.parquet(f"{tmp_path}/embeddings.parquet")).collect()}
    return str(tmp_path), greys


def test_frames_have_64_places(spark, uneven):
    """Places after a vector's end are unknown, components after the 64th are no pixels."""
    path, greys = uneven
    pixels = {(r.frame_idx, r.y, r.x): r.v for r in queries._pixels(spark, path).collect()}
    assert pixels == {(i, k // 8, k % 8): p[k] if p and k < len(p) else None for i, p in greys.items() for k in range(64)}
    top = [max(p[k] for p in greys.values() if p and k < len(p)) for k in range(64)]
    dark = {(i, k // 8, k % 8) for i, p in greys.items() for k in range(min(64, len(p or []))) if top[k] - p[k] > 40}
    runs = {(i, y, x) for i, y, x in dark if (i, y, x - 1) not in dark}
    found = queries.row_runs(spark, path).collect()
    assert {(r.frame_idx, r.y, r.x0) for r in found} == runs and len(found) == len(runs)
    assert {(r.frame_idx, r.y, x) for r in found for x in range(r.x0, r.x1 + 1)} == dark
    medians = queries.patch_median(spark, path).collect()
    assert [len(r.patch.split(",")) for r in medians] == [64]


def test_unknown_greys_are_no_difference(spark, uneven):
    """A vector of any length meets its successor, turned as a whole frame; without a common place there is no number."""
    path, greys = uneven
    whole = {i: [*(p or []), *[None] * 64][:64] for i, p in greys.items()}

    def off(a, b):
        squares = [(x - y) ** 2 for x, y in zip(a, b) if x is not None and y is not None]
        return [math.sqrt(sum(squares) / 64)] if squares else []

    wanted = {i: min(off(whole[i], whole[i + 1]) + off(whole[i], whole[i + 1][::-1]), default=None) for i in range(16)}
    got = {r.vec_id: r.rmse for r in queries.patch_rmse_flip(spark, path).collect()}
    assert got == {i: v if v is None else pytest.approx(v, abs=1e-6) for i, v in wanted.items()}
    assert [i for i, v in got.items() if v is None] and sum(v is not None for v in got.values()) > 10
    strict = spark.sql("select array(1, null) as a, array(3, 4) as b, cast(array() as array<int>) as e")
    row = strict.select(patches.rmse("a", "b").alias("x"), patches.rmse("a", "b", known=True).alias("y"), patches.rmse("e", "e").alias("z")).first()
    assert tuple(row) == (None, math.sqrt(2), None)


def test_patches_of_any_length_have_a_canonical_turn(spark, uneven):
    """Halves of a patch that ends within a row are told apart by their sums, as what it lacks is black."""
    path, greys = uneven
    halves = {i: [sum(v for k, v in enumerate(p or []) if (k % 8 >= 4) == right) for right in (False, True)] for i, p in greys.items()}
    wanted = {i: p if p is None else ",".join(map(str, p[::-1] if halves[i][0] < halves[i][1] else p)) for i, p in greys.items()}
    assert {r.vec_id: r.patch for r in queries.patch_canonical(spark, path).collect()} == wanted
