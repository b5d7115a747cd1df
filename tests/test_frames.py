"""Raw frames as a source and as a stream, up to tracks; state of learned area and patches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_outlines import ellipse
from trackloom.operators import appearance, detect, tracking
from trackloom.sources import frames
from trackloom.streaming.frames import frames_to_tracks
from trackloom.streaming.state import learned_area_stream, running_patch_stream


def movie(n, h=48, w=64):
    """Two animals that pass each other."""
    out = []
    for i in range(n):
        mask = ellipse(h, w, 10 + i, 14, 6, 4, 0) | ellipse(h, w, 54 - i, 34, 6, 4, 0)
        out.append(np.where(mask, 40, 220).astype(np.uint8).tobytes())
    return out


def test_reading_only_what_is_asked_for(spark, tmp_path, monkeypatch):
    (tmp_path / "m_2x2.gray").write_bytes(bytes(k % 256 for k in range(1000) for _ in range(4)))
    (tmp_path / "other_2x3.gray").write_bytes(bytes(6 * 7 + 5))
    frames.register(spark)
    read = spark.read.format("grayframes").option("framesPerPartition", 100).load(f"{tmp_path}/*.gray")
    assert read.groupBy("recording_id").count().orderBy("recording_id").collect() == [("m", 1000), ("other", 7)]
    wanted = [3, 17, 500, 999]
    got = read.filter(F.col("frame_idx").isin(wanted) & (F.col("recording_id") == "m")).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.gray[0]) for r in got] == [(i, i % 256) for i in wanted]
    assert read.filter("frame_idx >= 990 and frame_idx < 995").count() == 5 and read.filter("frame_idx = 4").count() == 2

    def asked(*filters, **options):
        """Frames that the reader's partitions name, each one read by a seek."""
        reader = frames.FrameReader({"path": f"{tmp_path}/m*.gray", **options})
        assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark applies them again
        return [i for p in reader.partitions() for i in p.frames]

    name = ("frame_idx",)
    assert asked(frames.In(name, tuple(wanted))) == wanted and asked(frames.EqualTo(("width",), 2)) == list(range(1000))
    assert asked(frames.GreaterThan(name, 10), frames.LessThanOrEqual(name, 13)) == [11, 12, 13]
    assert asked(frames.GreaterThanOrEqual(name, 10), frames.LessThan(name, 20), start="1", every="4") == [13, 17]
    assert asked(frames.In(name, (5, 9)), frames.EqualTo(name, 9)) == [9] and asked(frames.EqualTo(name, 5000)) == []
    assert sorted(map(tuple, frames.probe(spark, f"{tmp_path}/*.gray").collect())) == [("m", 2, 2, 1000), ("other", 2, 3, 7)]
    with pytest.raises(ValueError):
        frames.FrameReader({"path": "x", "every": "0"})
    (tmp_path / "wrong.gray").write_bytes(b"1")
    with pytest.raises(ValueError, match="isn't named"):
        frames.totals(f"{tmp_path}/*.gray")


def test_growing_files_to_tracks(spark, tmp_path):
    """Two takes of a file that grows give what one batch over the whole file gives."""
    films = movie(30)
    file = tmp_path / "in" / "m_64x48.gray"
    file.parent.mkdir()
    frames.register(spark)
    stream = spark.readStream.format("grayframes").load(f"{tmp_path}/in/*.gray")
    background = spark.range(48).select(F.lit("m").alias("recording_id"), F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"), F.lit(220).alias("bg"))
    settings, how = tracking.Settings(n_animals=2), {"min_area": 20, "max_area": 500}
    for k, until in enumerate((12, 30)):
        file.write_bytes(b"".join(films[:until]) + b"half a frame")
        got = frames_to_tracks(spark, stream, background, 60, str(tmp_path / "run"), settings, **how)
        assert got.select("frame_idx").distinct().count() == until
    px = frames.grey_values(spark.read.format("grayframes").load(f"{tmp_path}/in/*.gray"))
    want = tracking.track_detections(detect.detect_frames(px, background, 60, **how), settings)
    columns = ["recording_id", "frame_idx", "det_idx", "track_id", "cx_px", "cy_px", "area_px"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(got) == rows(want) and len(rows(got)) == 60
    first = {r.track_id: r.cx_px for r in got.filter("frame_idx = 0").collect()}
    last = {r.track_id: r.cx_px for r in got.filter("frame_idx = 29").collect()}
    assert {k: round(last[k] - first[k]) for k in first} in ({0: 29, 1: -29}, {0: -29, 1: 29})


def taken(spark, tmp_path, name, batches, stream):
    """The rows that a stream gives over some takes of parquet files."""
    source = f"{tmp_path}/{name}"
    for k, batch in enumerate(batches):
        batch.coalesce(1).write.parquet(f"{source}/in/{k}")
        out = stream(spark.readStream.schema(batch.schema).option("recursiveFileLookup", True).parquet(f"{source}/in"))
        query = out.writeStream.format("parquet").option("path", f"{source}/out").option("checkpointLocation", f"{source}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{source}/out")


def test_state_equals_batch(spark, tmp_path):
    rng = np.random.RandomState(2)
    rows = [(r, "m", i, float(rng.randint(50, 150)) if rng.rand() < 0.7 else None) for r in ("a", "b") for i in range(20) for _ in range(3)]
    df = spark.createDataFrame(rows, "recording_id string, roi_label string, frame_idx long, area_px double")
    parts = [df.filter("frame_idx < 5"), df.filter("frame_idx between 5 and 11"), df.filter("frame_idx > 11")]
    got = {r.recording_id: (r.frame_idx, r.expected_area_px) for r in taken(spark, tmp_path, "area", parts, lambda s: learned_area_stream(s, 9)).collect()}
    want = {r.recording_id: r.expected_area_px for r in appearance.learned_area(df, 9).collect()}
    assert got == {k: (8, v) for k, v in want.items()} and len(got) == 2
    patches = [("a", "m", t, i, [int(v) for v in rng.randint(0, 256, 4)], bool(rng.rand() < 0.8)) for t in (0, 1) for i in range(16)]
    pf = spark.createDataFrame(patches, "recording_id string, roi_label string, track_id int, frame_idx long, patch array<int>, is_confident boolean")
    got = taken(spark, tmp_path, "patch", [pf.filter("frame_idx < 7"), pf.filter("frame_idx >= 7")], lambda s: running_patch_stream(s, 5))
    key = lambda r: (r.track_id, r.frame_idx)
    assert {key(r): r.median_patch for r in got.collect()} == {key(r): r.median_patch for r in appearance.running_patch(pf, 5).collect()}


def test_frames_without_detections_count_while_learning(spark):
    """Learning counts frames, not only those with a blob; without any area it goes on."""
    rows = [("a", "m", i, 100.0 if i in (1, 4) else 300.0 if i == 6 else None) for i in range(8)] + [("b", "m", i, None if i < 6 else 70.0) for i in range(8)]
    df = spark.createDataFrame(rows, "recording_id string, roi_label string, frame_idx long, area_px double")
    assert sorted(map(tuple, appearance.learned_area(df, 5).collect())) == [("a", "m", 100.0), ("b", "m", 70.0)]
