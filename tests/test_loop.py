"""Verdicts as a stream of re-audits; recordings' own metadata; files of settings and regions."""

from pyspark.sql import functions as F

from trackloom.operators import audit
from trackloom.plans import stages
from trackloom.streaming.review import audit_stream, audited


def test_only_touched_recordings_are_audited_again(spark, tmp_path):
    rows = [(r, "m", t, i, 10.0 * i + (3 if 8 <= i < 12 else 40) * t, 50.0) for r in ("a", "b", "c") for t in (0, 1) for i in range(24)]
    tracks = spark.createDataFrame(rows, "recording_id string, roi_label string, track_id int, frame_idx long, cx_smooth_px double, cy_smooth_px double")
    calls = []

    def run(df, verdicts):
        calls.append(sorted(r.recording_id for r in df.select("recording_id").distinct().collect()))
        return audit.audit_tracks(df, 10.0, 1.0, 5.0, ratio=0.01, max_jump_px=200.0, verdicts=verdicts)[0]

    blocks = {r.recording_id: r for r in audit.audit_tracks(tracks, 10.0, 1.0, 5.0, ratio=0.01, max_jump_px=200.0)[1].collect()}
    assert not blocks  # nothing is swapped by cost
    schema = "recording_id string, roi_label string, event_id string, verdict string, swap array<int>, timestamp_iso string"
    takes = [[(r, "m", "8-0-1", "accept_swap", None, "2024-01-01") for r in ("a", "b")], [("b", "m", "8-0-1", "reject_swap", None, "2024-01-02")], [("c", "m", "8-0-1", "mount", None, "2024-01-02")]]
    root = f"{tmp_path}/root"
    seen = []
    for k, take in enumerate(takes):
        spark.createDataFrame(take, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        audit_stream(stream, tracks, run, root, f"{tmp_path}/state", once=True).awaitTermination()
        seen.append({r.recording_id: (r.batch, r.moved, r.mounts) for r in audited(spark, root).groupBy("recording_id", "batch").agg(
            F.count_if(F.col("track_id") != F.col("original_track_id")).alias("moved"), F.count_if(F.col("event_type") == "mount").alias("mounts")).collect()})
    assert calls == [["a", "b"], ["b"], ["c"]]
    assert seen[0] == {"a": (0, 24, 0), "b": (0, 24, 0)} and seen[1] == {"a": (0, 24, 0), "b": (1, 0, 0)}
    assert seen[2] == {**seen[1], "c": (2, 0, 8)}


def test_metadata_of_each_recording(spark):
    df = spark.createDataFrame([("a", 0, 10.0), ("b", 0, 10.0), ("c", 0, 10.0)], "recording_id string, frame_idx long, cx_px double")
    meta = spark.createDataFrame([("a", 25.0, 10.0), ("b", 30.0, None)], "recording_id string, fps double, px_per_mm double")
    got = {r.recording_id: (r.fps, r.px_per_mm) for r in stages.with_meta(df, meta).collect()}
    assert got == {"a": (25.0, 10.0), "b": (30.0, None), "c": (None, None)}
    assert {r.recording_id: (r.fps, r.px_per_mm) for r in stages.with_meta(df, meta, fps=50.0, px_per_mm=4.0).collect()} == {k: (50.0, 4.0) for k in "abc"}
