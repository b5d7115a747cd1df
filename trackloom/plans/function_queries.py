"""Registered queries of single functions, sources and small operators, over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, scalar
from ..operators import appearance, clean, detect, events, metrics, raster, review
from ..schema import AUDITED, FRAME
from ..sources import tables
from ..sources.adapters import FPS, patches_from_embeddings
from ..sources.scratch import shared_dir, spread
from . import stages
from .queries import REC, REGIONS, TRACK, _candidates, _detections, _framed, _pixels, _r, _raw, _read, _swap_log, _verdicts


def ellipse_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("major_axis_px"), F.col("minor_axis_px")
    area = scalar.ellipse_area(a, b)
    df = _detections(spark, sf_dir).withColumns({"perimeter": scalar.ellipse_perimeter(a, b), "area": area, "radius": scalar.suppression_radius(area)})
    return _r(df, TRACK, ["perimeter", "area", "radius"])


def permutation_text(spark, sf_dir):
    """A permutation as text and back, from commas and from brackets, and whether it is one of its ids."""
    p = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: ((i + F.col(FRAME)) % 3).cast("int"))
    df = _detections(spark, sf_dir).withColumn("p", p)
    code, listed = scalar.encode_permutation(F.col("p")), F.concat(F.lit("["), F.array_join(F.col("p").cast("array<string>"), ", "), F.lit("]"))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return df.select(
        *TRACK, code.alias("code"), text(scalar.int_list(code)).alias("decoded"), text(scalar.int_list(listed)).alias("parsed"),
        scalar.int_list(F.translate(code, ",", "-")).isNull().alias("refused"), scalar.is_permutation(F.col("p"), F.array(F.lit(0), F.lit(1), F.lit(2))).alias("is_permutation"),
    )


def suffix_strip(spark, sf_dir):
    name = F.concat(F.col(REC), F.when(F.col("track_id") % 2 == 0, "_clean.csv").otherwise("_raw.csv"))
    return _detections(spark, sf_dir).select(*TRACK, scalar.strip_suffix(name, "_clean.csv", ".csv").alias("stem"))


def time_spec(spark, sf_dir):
    """Frame numbers as hours, minutes and seconds; other texts give nothing."""
    f = F.col(FRAME)
    spec = F.concat_ws(":", F.floor(f / 3600), F.floor(f / 60) % 60, f % 60)
    spec = F.when(f % 7 == 0, F.concat(spec, F.lit(":x"))).when(f % 3 == 0, F.concat_ws(":", F.floor(f / 60) % 60, f % 60)).otherwise(spec)
    return _detections(spark, sf_dir).select(*TRACK, scalar.parse_time(spec).alias("seconds"))


def utc_text(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", scalar.utc_iso(F.col("ts")).alias("iso"))


def shape_points(spark, sf_dir):
    """Of each recording: edges of the box of its positions, and points of the circle around the box's middle that a world frame may start from."""
    ends = [F.min("cx_px").alias("x0"), F.max("cx_px").alias("x1"), F.min("cy_px").alias("y0"), F.max("cy_px").alias("y1")]
    box = _detections(spark, sf_dir).groupBy(REC).agg(*ends)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    edges = box.select(REC, F.lit("edge").alias("kind"), F.explode(geometry.box_edges(x0, y0, x1, y1)).alias("p")).select(REC, "kind", "p.*")
    ring = geometry.circle_origins((x0 + x1) / 2, (y0 + y1) / 2, F.least(x1 - x0, y1 - y0) / 2)
    origins = box.select(REC, F.lit("origin").alias("kind"), F.explode(ring).alias("p")).select(REC, "kind", "p.*", F.lit(None).cast("double").alias("length"))
    return _r(edges.unionByName(origins), [REC, "kind", "name"], ["x", "y", "length"])


def trim_window(spark, sf_dir):
    """Trims of a minute as the tuner and the annotator read them, and ranges of frames to show with a frame's place in them."""
    f, end = F.col(FRAME).cast("double"), F.lit(60.0)
    start_s, end_s = F.when(F.col(FRAME) % 4 > 0, f), F.when(F.col(FRAME) % 5 > 0, f + 10)
    total = F.lit(50).cast("bigint")
    shown = scalar.clamp_range(F.col(FRAME) - 20, F.when(F.col(FRAME) % 3 > 0, F.col(FRAME) - 10).otherwise(F.lit(0)), total)
    df = _detections(spark, sf_dir).select(*TRACK, scalar.trim_fractions(start_s, end_s, end).alias("p"), scalar.trim_span(start_s, end_s, end).alias("q"), shown.alias("c"))
    df = df.select(
        *TRACK, F.col("p.start").alias("from_part"), F.col("p.end").alias("to_part"), F.col("q.start").alias("from_span"), F.col("q.end").alias("to_span"), "c.lo", "c.hi",
        scalar.clamp_frame(F.col(FRAME), F.col("c")).alias("nearest"), scalar.frame_fraction(F.col(FRAME), total).alias("place"),
    )
    return _r(df, [*TRACK, "lo", "hi", "nearest"], ["from_part", "to_part", "from_span", "to_span", "place"])


def track_palette(spark, sf_dir):
    """Colours of tracks, fixed and made, and the channels of the fixed ones."""
    df = _detections(spark, sf_dir).select((F.col(FRAME) % 24).cast("int").alias("i")).distinct()
    df = df.withColumn("colour", scalar.track_colour(F.col("i"))).withColumn("c", scalar.hex_channels(F.col("colour")))
    return df.select("i", "colour", F.col("c.b").alias("b"), F.col("c.g").alias("g"), F.col("c.r").alias("r"))


def improvement(spark, sf_dir):
    after = F.when(F.col(FRAME) % 5 == 0, F.lit(float("nan"))).otherwise(F.col("cx_px"))
    return _detections(spark, sf_dir).select(*TRACK, scalar.improvement_ratio(F.col("cy_px"), after).alias("ratio"))


def polarity_route(spark, sf_dir):
    """The background that detection needs and the other one, which shows trails, by polarity."""
    kind = F.element_at(F.array(F.lit("dark_on_light"), F.lit("light_on_dark")), (F.col("x") % 2 + 1).cast("int"))
    both = scalar.polarity_backgrounds(kind, F.col("v_max").cast("double"), F.col("v_min").cast("double"))
    return raster.projections(_pixels(spark, sf_dir)).select(F.col(REC).cast("int").alias("label"), "y", "x", both.alias("b")).select("label", "y", "x", "b.*")


def zoom_box(spark, sf_dir):
    """Frames to show around each candidate event."""
    df = _candidates(spark, sf_dir).withColumn("z", scalar.zoom_window(F.col("frame_start"), F.col("frame_end"), 41))
    return df.select(REC, "event_id", "z.*")


def frame_clock(spark, sf_dir):
    """Of each detection: its frame of half seconds (halves to even), and its column in a strip over its recording's frames."""
    w = Window.partitionBy(REC)
    df = _detections(spark, sf_dir).withColumns({"lo": F.min(FRAME).over(w), "hi": F.max(FRAME).over(w)})
    at, column = scalar.seconds_to_frame(F.col(FRAME) / 4, 2.0), scalar.raster_column(F.col(FRAME), F.col("lo"), F.col("hi"), 50)
    return df.select(*TRACK, at.alias("at"), column.alias("strip"))


def first_frames(spark, sf_dir):
    return stages.first_frames(_detections(spark, sf_dir), 10).select(*TRACK, "cx_px")


def event_order(spark, sf_dir):
    """Each recording's events in the order of sinks: by start frame, then id as text; the first 20 are a preview."""
    w = Window.partitionBy(REC).orderBy("frame_start", "event_id")
    return _candidates(spark, sf_dir).select(REC, "event_id", F.row_number().over(w).alias("place")).filter("place <= 20")


def window_medians(spark, sf_dir):
    return _r(appearance.window_features(_detections(spark, sf_dir), [REC, "track_id"]), [REC, "track_id"], ["area_px", "axis_ratio"])


def mask_share(spark, sf_dir):
    """What a disc with a hole keeps of each recording's image."""
    regions = [{"operation": "add", "geometry": geometry.circle(3.5, 3.5, 3)}, {"operation": "subtract", "geometry": geometry.rectangle((3, 3), (4, 4))}]
    out = raster.mask_share(_pixels(spark, sf_dir).select(REC, "y", "x").distinct(), regions)
    return _r(out.select(F.col(REC).cast("int").alias("label"), "kept_px", "kept_share"), ["label", "kept_px"], ["kept_share"])


def axis_gate(spark, sf_dir):
    return detect.gate_ratio(_detections(spark, sf_dir), 4.0).select(*TRACK)


def flag_counts(spark, sf_dir):
    from ..operators import seq

    df = seq.flag_outliers(_detections(spark, sf_dir), 20.0, 0.1).withColumn("even", F.when(F.col(FRAME) % 3 > 0, F.col(FRAME) % 2 == 0))
    return metrics.flag_counts(df, ["outlier_rejected", "even"]).select(REC, "track_id", "n_outlier_rejected", "n_even", "n_rows")


def tuning_spread(spark, sf_dir):
    columns = ["area_px", "major_axis_px"]
    out = metrics.spread(_detections(spark, sf_dir), columns)
    return _r(out, [REC], [f"{c}_{k}" for c in columns for k in ("mean", "sd", "min", "max")])


def recording_extent(spark, sf_dir):
    return _r(metrics.extent(_detections(spark, sf_dir), FPS), [REC, "first_frame", "last_frame", "n_frames"], ["duration_s"])


def exact_frame(spark, sf_dir):
    return _detections(spark, sf_dir).filter(F.col(FRAME) == 14).select(*TRACK, "cx_px")


def region_plan(spark, sf_dir):
    return metrics.by_region(_detections(spark, sf_dir), REGIONS).select(*TRACK, "roi_label")


def reviewed_ids(spark, sf_dir):
    """Different tracks of each recording that verdicts name."""
    v = _verdicts(spark, sf_dir)
    return v.select(REC, F.explode(F.array("animal_a", "animal_b")).alias("track_id")).distinct()


def detections_file(spark, sf_dir):
    """Detections written as text with their decimals, and read again."""
    full = _detections(spark, sf_dir).withColumns({"x_mm": F.col("cx_px") / 3, "y_mm": F.col("cy_px") / 7, "perimeter_px": F.lit(40.126), "solidity": F.lit(0.92347)})
    path = shared_dir(spark, "csv")
    tables.write_detections(full, path)
    back = tables.read_detections(spark, path)
    return back.select(*TRACK, "roi_label", "cx_px", "x_mm", "y_mm", "area_px", "perimeter_px", "solidity")


def trajectory_file(spark, sf_dir):
    """A tagged trajectory written as text with four places, and read again without the mounts."""
    df = _raw(spark, sf_dir).withColumn("event_type", F.when(F.col(FRAME) % 4 == 0, "mount").otherwise("")).withColumn("original_track_id", F.col("track_id"))
    back = tables.read_trajectory(spark, tables.write_trajectory(df.withColumn("cx_smooth_px", F.col("cx_px") / 3), shared_dir(spark, "csv"), AUDITED))
    return back.select(*TRACK, "cx_smooth_px", "heading_deg", F.col("speed_mm_s").isNull().alias("no_speed"))


def candidates_file(spark, sf_dir):
    """Candidates written twice: a reader of the folder follows its pointer to the newer version."""
    path, found = shared_dir(spark, "csv"), _candidates(spark, sf_dir).withColumn("n_frames", F.lit(3))
    tables.write_events(found.filter("frame_start % 2 = 0"), path)
    tables.write_events(found, path)
    back = tables.read_candidates(spark, path)
    return _r(back, [REC, "event_id", "frame_start", "frame_end", "animal_a", "animal_b", "source", "n_frames"], ["min_distance_px", "max_jump_px"])


def verdicts_file(spark, sf_dir):
    """A log with a later row for some events: the last one of each is read."""
    old = _verdicts(spark, sf_dir).withColumn("permutation", scalar.encode_permutation(F.array(F.lit(1), F.lit(0))))
    later = old.filter("frame_start % 4 = 0").withColumns({"verdict": F.lit("reject_swap"), "timestamp_iso": F.lit("2024-01-02T00:00:00+00:00")})
    path = shared_dir(spark, "csv")
    tables.write_events(old.unionByName(later), path)
    back = tables.read_verdicts(spark, path)
    return back.select(REC, "event_id", "verdict", "timestamp_iso", F.array_join(F.col("swap").cast("array<string>"), ",").alias("swap"))


def swap_log_file(spark, sf_dir):
    log = _swap_log(spark, sf_dir).withColumns({"permutation": F.array(F.lit(1), F.lit(0)), "improvement_ratio": scalar.improvement_ratio(F.col("cost_before"), F.col("cost_after"))})
    back = tables.read_swap_log(spark, tables.write_events(log, shared_dir(spark, "csv")))
    return back.select(REC, "event_id", "verdict", "permutation", "cost_before", "improvement_ratio", F.col("cost_area_after").isNull().alias("no_area_cost"))


def sidecar_file(spark, sf_dir):
    """Recordings' extents written as sidecars of this version, and read again."""
    found = metrics.extent(_detections(spark, sf_dir), FPS)
    trim = F.struct(F.col("first_frame").cast("double").alias("start_s"), F.col("last_frame").cast("double").alias("end_s"))
    video = F.struct(F.col(REC).alias("path"), F.lit(None).cast("string").alias("sha256"), F.array(F.lit(490), F.lit(400)).alias("frame_size"), F.lit(FPS).alias("fps"))
    arena = F.struct(F.lit("circle").alias("shape"), F.lit(json.dumps({"cx": 245, "cy": 200, "r": 180})).alias("geometry"))
    path = shared_dir(spark, "json")
    tables.write_json(found.select(F.lit(1).alias("schema_version"), video.alias("video"), arena.alias("arena"), trim.alias("trim")), path)
    back = tables.read_arena(spark, path)
    radius = F.from_json("arena.geometry", "cx double, cy double, r double")["r"]
    return back.select(F.col("video.path").alias(REC), "schema_version", F.col("video.fps").alias("fps"), F.col("trim.start_s").alias("start_s"), F.col("trim.end_s").alias("end_s"), radius.alias("r"))


def fingerprint_table(spark, sf_dir):
    """Patches written by recording, and read again."""
    p = patches_from_embeddings(_read(spark, sf_dir, "embeddings")).select(F.col("track_id").cast("string").alias(REC), "vec_id", "patch")
    path = shared_dir(spark, "fingerprints")
    tables.write_fingerprints(p, path)
    back = tables.read_fingerprints(spark, path)
    return back.select(F.col(REC).cast("int").alias("label"), "vec_id", F.array_join(F.col("patch").cast("array<string>"), ",").alias("patch"))


def trace_arrays(spark, sf_dir):
    out = events.traces(_detections(spark, sf_dir))
    return out.select(REC, "track_id", F.size("samples").cast("bigint").alias("n"), F.get("samples", F.lit(0))[FRAME].alias("first_frame"), F.element_at("samples", -1)["x"].alias("last_x"))


def sampled_frames(spark, sf_dir):
    """Seven evenly spaced frames of each recording, cut and rounded, by its own length."""
    df = _detections(spark, sf_dir)
    total = df.groupBy(REC).agg((F.max(FRAME) + 1).alias("n"))
    for name, rounded in (("cut", False), ("rounded", True)):
        frames = total.select(REC, F.explode(raster.sample_positions(F.col("n"), 7, 0.1, 0.9, rounded)).alias(FRAME), F.lit(True).alias(name))
        df = df.join(frames, [REC, FRAME], "left")
    return df.filter("cut or rounded").select(*TRACK, F.coalesce("cut", F.lit(False)).alias("cut"), F.coalesce("rounded", F.lit(False)).alias("rounded"))


def background_table(spark, sf_dir):
    """The brightest projection, made once and loaded then."""
    path, calls = shared_dir(spark, "background"), []

    def build():
        calls.append(1)
        return raster.projections(_pixels(spark, sf_dir))

    for force in (False, False, True):
        out = tables.load_or_build(spark, path, build, force)
    return out.select(F.col(REC).cast("int").alias("label"), "y", "x", "v_max", F.lit(len(calls)).alias("built"))


def frame_difference(spark, sf_dir):
    """Pixels that differ from the darkest projection either way, by frame."""
    px = _pixels(spark, sf_dir)
    bg = raster.projections(px).select(REC, "y", "x", F.col("v_min").alias("bg"))
    return raster.foreground(px, bg, 40, absolute=True).groupBy(FRAME).agg(F.count("*").alias("n_px"))


def clone_patch(spark, sf_dir):
    return raster.clone_disc(_pixels(spark, sf_dir), (2, 2), (5, 4), 1).select(FRAME, "y", "x", "v")


def brush_stamp(spark, sf_dir):
    """Pixels that a brush covers around the tracks' places at each recording's every tenth frame."""
    centres = _detections(spark, sf_dir).filter(F.col(FRAME) % 10 == 0)
    centres = centres.select(REC, F.floor("cy_px").cast("int").alias("y"), F.floor("cx_px").cast("int").alias("x"))
    return raster.stamp_discs(centres, 4).groupBy(REC).agg(F.count("*").alias("n_px"), F.sum("y").alias("y"), F.sum("x").alias("x"))


def _placed(spark, sf_dir):
    """Two animals in each frame, turned by its number."""
    px = _pixels(spark, sf_dir)
    places = px.select(REC, FRAME).distinct().withColumn("track_id", F.explode(F.array(F.lit(0), F.lit(1))))
    shape = {"cx_px": 3.0 + F.col("track_id") * 2.5, "cy_px": 3.25 + F.col(FRAME) % 3, "orientation_deg": (F.col(FRAME) % 12 * 30 + 7).cast("double")}
    shape |= {"major_axis_px": 3.0 + F.col(FRAME) % 4, "minor_axis_px": 2.0 + F.col(FRAME) % 3, "area_px": 90.0 + 20 * (F.col(FRAME) % 3), "roi_label": F.lit("_merged")}
    return places.withColumns(shape), px


def pose_patches(spark, sf_dir):
    """4 x 6 patches along the long axes of two animals of each frame."""
    places, px = _placed(spark, sf_dir)
    out = appearance.pose_patches(places, px, 4, 6, key="track_id")
    return out.select(FRAME, "track_id", F.array_join(F.col("patch").cast("array<string>"), ",").alias("patch"))


def fingerprint_extract(spark, sf_dir):
    """Fingerprints of tracked animals from frames to the table and back: patch, canonical turn, confidence, shape."""
    places, px = _placed(spark, sf_dir)
    path = shared_dir(spark, "fingerprints")
    tables.write_fingerprints(appearance.fingerprints(places, px, 2, 100.0, 2.0, 0.2, 4, 6), path)
    back = tables.read_fingerprints(spark, path)
    return back.select(FRAME, "track_id", F.array_join(F.col("patch").cast("array<string>"), ",").alias("patch"), "is_confident", "area_px", "patch_h", "patch_w")


def running_patch(spark, sf_dir):
    p = _framed(spark, sf_dir)
    p = p.select(F.lit("all").alias(REC), F.lit("_merged").alias("roi_label"), "track_id", F.col("vec_id").alias(FRAME), "patch", (F.col("vec_id") % 3 != 0).alias("is_confident"))
    out = appearance.running_patch(p, 9)
    text = F.array_join(F.transform("median_patch", lambda v: F.when(v.isNotNull(), F.format_string("%.1f", v))), ",")
    return out.select("track_id", FRAME, F.nullif(text, F.lit("")).alias("patch"))


def verdict_problems(spark, sf_dir):
    """Verdicts with permutations of all kinds: what is wrong with them, and the pair that they change."""
    kinds = F.array(F.lit(""), F.lit("1,0,2"), F.lit("0,1,2"), F.lit("0,0,1"), F.lit("1-0"), F.lit("0,5"))
    df = _verdicts(spark, sf_dir).withColumn("permutation", F.element_at(kinds, (F.floor(F.col("frame_start") / 2) % 6 + 1).cast("int")))
    return review.check_verdicts(df).select(REC, "event_id", "problem")


def summary_file(spark, sf_dir):
    """Frames per track with mean places, written with four decimals and read as text."""
    out = _detections(spark, sf_dir).groupBy(REC, "track_id").agg(F.count("*").alias("n"), F.avg("cx_px").alias("cx_px"), F.avg("cy_px").alias("cy_px"))
    path = tables.write_csv(tables.four_places(out.withColumns({"cx_px": F.round("cx_px", 6) + 1e-9, "cy_px": F.round("cy_px", 6) + 1e-9})), shared_dir(spark, "csv"))
    back = spark.read.option("header", True).csv(path)
    return back.select(REC, F.col("track_id").cast("int"), F.col("n").cast("bigint").alias("n"), "cx_px", "cy_px")


def file_hash(spark, sf_dir):
    """SHA-256 of a text file of each recording."""
    path = shared_dir(spark, "text")
    names = _detections(spark, sf_dir).select(REC).distinct()
    spread(names.select(REC, F.concat(F.lit("recording "), F.col(REC)).alias("value"))).write.partitionBy(REC).text(path)
    found = tables.file_hashes(spark, path, "*.txt")
    return found.select(F.regexp_extract("path", f"{REC}=([^/]+)/", 1).alias(REC), "sha256")


def tuning_params(spark, sf_dir):
    """Settings of each recording written as JSON, some left out; read with defaults for these."""
    n = F.regexp_extract(REC, "([0-9]+)", 1).cast("int")
    rows = _detections(spark, sf_dir).select(REC).distinct()
    rows = rows.select(F.lit(1).alias("schema_version"), REC, F.when(n % 3 > 0, 20 + n).alias("threshold"), F.when(n % 2 > 0, F.lit("chain")).alias("splitter"), F.lit(7).alias("unknown"))
    path = shared_dir(spark, "json")
    tables.write_json(rows, path)
    schema = f"schema_version int, {REC} string, threshold int, splitter string"
    return tables.read_params(spark, path, schema, {"threshold": 25, "splitter": "watershed"}).select(REC, "threshold", "splitter")


def roi_sidecar(spark, sf_dir):
    """Regions of each recording written as a sidecar and read again, in order."""
    roi = lambda op, label, shape, text: F.struct(F.lit(op).alias("operation"), F.lit(label).alias("label"), F.lit(shape).alias("shape"), text.alias("geometry"))
    far = F.max("cx_px").cast("string")
    rows = _detections(spark, sf_dir).groupBy(REC).agg(F.array(roi("add", "disc", "circle", F.concat(F.lit("r="), far)), roi("subtract", "hole", "rectangle", F.col(REC))).alias("rois"))
    path = shared_dir(spark, "json")
    tables.write_json(rows.select(F.lit(1).alias("schema_version"), F.col(REC).alias("mode"), "rois"), path)
    back = tables.read_rois(spark, path).select(F.col("mode").alias(REC), F.posexplode("rois").alias("place", "r"))
    return back.select(REC, "place", "r.operation", "r.label", "r.shape", F.regexp_replace("r.geometry", "=.*", "").alias("geometry"))


def filled_labels(spark, sf_dir):
    """Labels known at every fourth frame, carried on and back over the others."""
    label = F.when(F.col(FRAME) % 4 == 0, F.concat(F.lit("roi"), F.col(FRAME) % 3))
    return clean.fill_labels(_detections(spark, sf_dir).withColumn("roi", label), "roi", [REC, "track_id"]).select(*TRACK, "roi")


def mask_intersection(spark, sf_dir):
    """Dark pixels inside both the arena and a region, by frame."""
    px = _pixels(spark, sf_dir)
    fg = raster.foreground(px, raster.projections(px).select(REC, "y", "x", F.col("v_max").alias("bg")), 20)
    arena, roi = ([{"operation": "add", "geometry": g}] for g in (geometry.circle(3.5, 3.5, 3), geometry.rectangle((2, 0), (7, 4))))
    return raster.masked(raster.masked(fg, arena), roi).groupBy(FRAME).agg(F.count("*").alias("n_px"))


def recording_meta(spark, sf_dir):
    """World places by each recording's own scale, from sidecars of every other recording; others have the scale that is given."""
    df = _detections(spark, sf_dir)
    n = F.regexp_extract(REC, "([0-9]+)", 1).cast("int")
    meta = df.select(REC).distinct().filter(n % 2 == 0).select(REC, (20.0 + n % 5).alias("fps"), (2.0 + n % 4).alias("px_per_mm"))
    out = stages.with_meta(df, meta).withColumns({"fps": F.coalesce("fps", F.lit(25.0)), "px_per_mm": F.coalesce("px_per_mm", F.lit(8.0))})
    return _r(out.select(*TRACK, (F.col("cx_px") / F.col("px_per_mm")).alias("x_mm"), (F.col(FRAME) / F.col("fps")).alias("seconds")), TRACK, ["x_mm", "seconds"])


QUERIES = {
    f.__name__: f
    for f in (
        ellipse_shape, permutation_text, suffix_strip, time_spec, utc_text, shape_points, trim_window, track_palette, improvement, polarity_route,
        zoom_box, frame_clock, first_frames, event_order, window_medians, mask_share, axis_gate, flag_counts, tuning_spread,
        recording_extent, exact_frame, region_plan, reviewed_ids, detections_file, trajectory_file, candidates_file, verdicts_file, swap_log_file,
        sidecar_file, fingerprint_table, trace_arrays, sampled_frames, background_table, frame_difference, clone_patch, brush_stamp, pose_patches, fingerprint_extract, running_patch, verdict_problems,
        summary_file, file_hash, tuning_params, roi_sidecar, filled_labels, mask_intersection, recording_meta,
    )
}
