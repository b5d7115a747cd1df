"""SQL for the queries of single functions, sources and small operators."""

from __future__ import annotations

from .oracle import _IN_DISC, _IN_TRIANGLE, DET, PIXELS, REVIEW, _with

_AREA = "(pi() / 4 * major_axis_px * minor_axis_px)"
_KEY = "recording_id, track_id, frame_idx"

def _round(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _channel(shift: int) -> str:
    k = f"(({shift} + h * 6) % 6)"
    return f"printf('%02x', CAST(floor((0.9::DOUBLE - 0.9::DOUBLE * 0.7::DOUBLE * greatest(0, least({k}, 4 - {k}, 1))) * 255) AS INTEGER))"


def _byte(at: int) -> str:
    digit = lambda i: f"(instr('0123456789abcdef', substr(colour, {i}, 1)) - 1)"
    return f"CAST({digit(at)} * 16 + {digit(at + 1)} AS INTEGER)"


_CORNER = "sum((1 - abs(sy - (floor(sy) + dy))) * (1 - abs(sx - (floor(sx) + dx))) * coalesce(p.v, 0))"

# Cells of a rectangle of 1.5 axes, at least a pixel each, and their greys from the four pixels around.
_POSE = """,
place AS (
  SELECT label, frame_idx, CAST(d AS INTEGER) AS track_id, 3.0::DOUBLE + d * 2.5 AS cx, 3.25::DOUBLE + frame_idx % 3 AS cy, radians(frame_idx % 12 * 30 + 7 - 90.0::DOUBLE) AS t, pos,
         (pos % 6 / 5.0::DOUBLE - 0.5) * greatest(1.5 * (3 + frame_idx % 4), 6) AS u, (pos // 6 / 3.0::DOUBLE - 0.5) * greatest(1.5 * (2 + frame_idx % 3), 4) AS v
  FROM (SELECT DISTINCT label, frame_idx FROM px), range(2) a(d), range(24) b(pos)),
src AS (SELECT label, frame_idx, track_id, pos, round(cx + cos(t) * u - sin(t) * v, 6) AS sx, round(cy + sin(t) * u + cos(t) * v, 6) AS sy FROM place),
grey AS (
  SELECT s.frame_idx, s.track_id, s.pos, CAST(floor(least(greatest(round(""" + _CORNER + """, 6) + 0.5, 0), 255)) AS INTEGER) AS v
  FROM src s CROSS JOIN range(2) a(dy) CROSS JOIN range(2) b(dx) LEFT JOIN px p ON p.label = s.label AND p.frame_idx = s.frame_idx AND p.y = floor(sy) + dy AND p.x = floor(sx) + dx
  GROUP BY s.frame_idx, s.track_id, s.pos)"""

SQL: dict[str, str] = {
    "ellipse_shape": _with(
        DET,
        f"SELECT {_KEY}, round(pi() * (major_axis_px + minor_axis_px) / 2 * (1 + 3 * h / (10 + sqrt(4 - 3 * h))), 6) AS perimeter, "
        f"round({_AREA}, 6) AS area, round(sqrt({_AREA} / pi()), 6) AS radius FROM (SELECT *, ((major_axis_px - minor_axis_px) / (major_axis_px + minor_axis_px)) ** 2 AS h FROM det)",
    ),
    "permutation_text": _with(
        DET + ", p AS (SELECT *, [frame_idx % 3, (frame_idx + 1) % 3, (frame_idx + 2) % 3] AS p FROM det)",
        f"SELECT {_KEY}, array_to_string(p, ',') AS code, array_to_string(p, ',') AS decoded, array_to_string(p, ',') AS parsed, true AS refused, true AS is_permutation FROM p",
    ),
    "suffix_strip": _with(DET, f"SELECT {_KEY}, recording_id || CASE WHEN track_id % 2 = 0 THEN '' ELSE '_raw' END AS stem FROM det"),
    "time_spec": _with(DET, f"SELECT {_KEY}, CAST(CASE WHEN frame_idx % 7 = 0 THEN NULL WHEN frame_idx % 3 = 0 THEN frame_idx % 3600 ELSE frame_idx END AS DOUBLE) AS seconds FROM det"),
    "utc_text": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events",
    "shape_points": _with(
        DET + """,
box AS (SELECT recording_id, min(cx_px) AS x0, max(cx_px) AS x1, min(cy_px) AS y0, max(cy_px) AS y1 FROM det GROUP BY recording_id),
ring AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, least(x1 - x0, y1 - y0) / 2 AS r FROM box),
point AS (
  SELECT recording_id, 'edge' AS kind, '0' AS name, x0 AS x, y0 AS y, x1 - x0 AS length FROM box UNION ALL SELECT recording_id, 'edge', '1', x1, y0, y1 - y0 FROM box
  UNION ALL SELECT recording_id, 'edge', '2', x1, y1, x1 - x0 FROM box UNION ALL SELECT recording_id, 'edge', '3', x0, y1, y1 - y0 FROM box
  UNION ALL SELECT recording_id, 'origin', 'centre', cx, cy, NULL FROM ring UNION ALL SELECT recording_id, 'origin', 'east', cx + r, cy, NULL FROM ring
  UNION ALL SELECT recording_id, 'origin', 'north', cx, cy - r, NULL FROM ring UNION ALL SELECT recording_id, 'origin', 'west', cx - r, cy, NULL FROM ring
  UNION ALL SELECT recording_id, 'origin', 'south', cx, cy + r, NULL FROM ring)""",
        f"SELECT recording_id, kind, name, {_round('x', 'y', 'length')} FROM point",
    ),
    "trim_window": _with(
        DET + """,
given AS (
  SELECT *, CASE WHEN frame_idx % 4 > 0 THEN frame_idx END AS s, CASE WHEN frame_idx % 5 > 0 THEN frame_idx + 10 END AS e,
         greatest(0, least(frame_idx - 20, 49)) AS lo, CASE WHEN frame_idx % 3 > 0 AND frame_idx <> 10 THEN least(frame_idx - 10, 49) ELSE 49 END AS top FROM det),
parts AS (
  SELECT *, CASE WHEN s IS NULL THEN 0.1 ELSE greatest(0, least(0.99, s / 60.0::DOUBLE)) END AS f, least(59.999, coalesce(s, 0))::DOUBLE AS g, greatest(lo + 1, top) AS hi FROM given)""",
        f"SELECT {_KEY}, lo, hi, greatest(lo, least(hi, frame_idx)) AS nearest, round(f, 6) AS from_part, "
        "round(CASE WHEN e IS NULL THEN 0.9 ELSE greatest(f + 0.01, least(1, e / 60.0::DOUBLE)) END, 6) AS to_part, round(g / 60, 6) AS from_span, "
        "round(greatest(g + 0.001, least(60, coalesce(e, 60))) / 60, 6) AS to_span, round(least(1, frame_idx / 49.0::DOUBLE), 6) AS place FROM parts",
    ),
    "track_palette": _with(
        DET + f""",
ids AS (SELECT DISTINCT CAST(frame_idx % 24 AS INTEGER) AS i FROM det),
hued AS (SELECT i, (i * 0.61803398875::DOUBLE) % 1 AS h FROM ids),
named AS (
  SELECT i, CASE WHEN i < 8 THEN ['#d55e00', '#56b4e9', '#009e73', '#e69f00', '#f0e442', '#cc79a7', '#0072b2', '#000000'][i + 1]
            ELSE '#' || {_channel(5)} || {_channel(3)} || {_channel(1)} END AS colour FROM hued)""",
        f"SELECT i, colour, {_byte(6)} AS b, {_byte(4)} AS g, {_byte(2)} AS r FROM named",
    ),
    "improvement": _with(DET, f"SELECT {_KEY}, CASE WHEN frame_idx % 5 > 0 AND cy_px > 0 THEN 1 - cx_px / cy_px ELSE 0 END AS ratio FROM det"),
    "polarity_route": _with(PIXELS, "SELECT label, y, x, CAST(CASE x % 2 WHEN 0 THEN v_max ELSE v_min END AS DOUBLE) AS detection, CAST(CASE x % 2 WHEN 0 THEN v_min ELSE v_max END AS DOUBLE) AS trail FROM proj"),
    "zoom_box": _with(REVIEW, "SELECT recording_id, event_id, (frame_start + frame_end) // 2 - 20 AS lo, (frame_start + frame_end) // 2 + 20 AS hi FROM cand"),
    "frame_clock": _with(
        DET + ", ends AS (SELECT *, min(frame_idx) OVER (PARTITION BY recording_id) AS lo, max(frame_idx) OVER (PARTITION BY recording_id) AS hi FROM det)",
        f"SELECT {_KEY}, CAST(frame_idx // 2 + CASE WHEN frame_idx % 4 = 3 THEN 1 ELSE 0 END AS BIGINT) AS at, "
        "CAST(floor((frame_idx - lo) / greatest(hi - lo, 1)::DOUBLE * 49) AS INTEGER) AS strip FROM ends",
    ),
    "first_frames": _with(DET + ", ranked AS (SELECT *, dense_rank() OVER (PARTITION BY recording_id ORDER BY frame_idx) AS r FROM det)", f"SELECT {_KEY}, cx_px FROM ranked WHERE r <= 10"),
    "event_order": _with(REVIEW, "SELECT recording_id, event_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY frame_start, event_id) AS INTEGER) AS place FROM cand QUALIFY place <= 20"),
    "window_medians": _with(DET, "SELECT recording_id, track_id, round(median(area_px), 6) AS area_px, round(median(major_axis_px / minor_axis_px), 6) AS axis_ratio FROM det GROUP BY recording_id, track_id"),
    "mask_share": _with(
        PIXELS + ", kept AS (SELECT label, (x - 3.5) ** 2 + (y - 3.5) ** 2 <= 9 AND NOT (x BETWEEN 3 AND 4 AND y BETWEEN 3 AND 4) AS k FROM (SELECT DISTINCT label, y, x FROM px))",
        "SELECT label, count(*) FILTER (k) AS kept_px, round(count(*) FILTER (k) / count(*), 6) AS kept_share FROM kept GROUP BY label",
    ),
    "axis_gate": _with(DET, f"SELECT {_KEY} FROM det WHERE minor_axis_px > 0 AND major_axis_px <= 4 * minor_axis_px"),
    "flag_counts": _with(
        DET + """,
valid AS (
  SELECT *, row_number() OVER w AS j,
         coalesce(sqrt((cx_px - lag(cx_px) OVER w) ** 2 + (cy_px - lag(cy_px) OVER w) ** 2) / (frame_idx - lag(frame_idx) OVER w) * 0.1 > 20, false) AS fast
  FROM det WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY frame_idx)),
flagged AS (SELECT *, fast AND (j - max(CASE WHEN NOT fast THEN j END) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx)) % 2 = 1 AS out FROM valid)""",
        "SELECT recording_id, track_id, count(*) FILTER (out) AS n_outlier_rejected, count(*) FILTER (frame_idx % 3 > 0 AND frame_idx % 2 = 0) AS n_even, count(*) AS n_rows FROM flagged GROUP BY recording_id, track_id",
    ),
    "tuning_spread": _with(
        DET,
        "SELECT recording_id, "
        + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in ("area_px", "major_axis_px") for n, f in (("mean", "avg"), ("sd", "stddev_pop"), ("min", "min"), ("max", "max")))
        + " FROM det GROUP BY recording_id",
    ),
    "recording_extent": _with(
        DET,
        "SELECT recording_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, max(frame_idx) - min(frame_idx) + 1 AS n_frames, CAST(max(frame_idx) - min(frame_idx) + 1 AS DOUBLE) AS duration_s "
        "FROM det GROUP BY recording_id",
    ),
    "exact_frame": _with(DET, f"SELECT {_KEY}, cx_px FROM det WHERE frame_idx = 14"),
    "region_plan": _with(DET, f"SELECT {_KEY}, 'disc' AS roi_label FROM det WHERE {_IN_DISC} UNION ALL SELECT {_KEY}, 'corner' FROM det WHERE {_IN_TRIANGLE}"),
    "reviewed_ids": _with(REVIEW, "SELECT recording_id, animal_a AS track_id FROM verd UNION SELECT recording_id, animal_b FROM verd"),
    "detections_file": _with(
        DET, f"SELECT {_KEY}, '_merged' AS roi_label, round(cx_px, 3) AS cx_px, round(cx_px / 3, 4) AS x_mm, round(cy_px / 7, 4) AS y_mm, area_px, 40.13::DOUBLE AS perimeter_px, 0.9235::DOUBLE AS solidity FROM det"
    ),
    "trajectory_file": _with(DET, f"SELECT {_KEY}, round(cx_px / 3, 4) AS cx_smooth_px, orientation_deg AS heading_deg, true AS no_speed FROM det WHERE frame_idx % 4 > 0"),
    "candidates_file": _with(
        REVIEW, f"SELECT recording_id, event_id, frame_start, frame_end, animal_a, animal_b, source, 3 AS n_frames, {_round('min_distance_px', 'max_jump_px')} FROM cand"
    ),
    "verdicts_file": _with(
        REVIEW,
        "SELECT recording_id, event_id, CASE WHEN frame_start % 4 = 0 THEN 'reject_swap' ELSE verdict END AS verdict, "
        "CASE WHEN frame_start % 4 = 0 THEN '2024-01-02T00:00:00+00:00' ELSE '2024-01-01T00:00:00+00:00' END AS timestamp_iso, '1,0' AS swap FROM verd",
    ),
    "swap_log_file": _with(
        REVIEW, "SELECT recording_id, event_id, verdict, '[1,0]' AS permutation, 10.0::DOUBLE AS cost_before, 0.6::DOUBLE AS improvement_ratio, true AS no_area_cost FROM log"
    ),
    "sidecar_file": _with(
        DET,
        "SELECT recording_id, 1 AS schema_version, 1.0::DOUBLE AS fps, CAST(min(frame_idx) AS DOUBLE) AS start_s, CAST(max(frame_idx) AS DOUBLE) AS end_s, 180.0::DOUBLE AS r FROM det GROUP BY recording_id",
    ),
    "fingerprint_table": _with(PIXELS, "SELECT track_id AS label, vec_id, array_to_string(p, ',') AS patch FROM patch"),
    "trace_arrays": _with(DET, "SELECT recording_id, track_id, count(*) AS n, min(frame_idx) AS first_frame, arg_max(cx_px, frame_idx) AS last_x FROM det GROUP BY recording_id, track_id"),
    "sampled_frames": _with(
        DET + """,
len AS (SELECT recording_id, floor((max(frame_idx) + 1) * 0.1::DOUBLE) AS lo, floor((max(frame_idx) + 1) * 0.9::DOUBLE) - 1 AS top FROM det GROUP BY recording_id),
asked AS (SELECT recording_id, lo + (greatest(lo, top) - lo) * i / 6 AS f FROM len, range(7) t(i)),
picked AS (
  SELECT recording_id, CAST(floor(f) AS BIGINT) AS frame_idx, true AS cut, false AS rounded FROM asked UNION ALL SELECT recording_id, CAST(round_even(f, 0) AS BIGINT), false, true FROM asked)""",
        "SELECT recording_id, track_id, frame_idx, bool_or(cut) AS cut, bool_or(rounded) AS rounded FROM det JOIN picked USING (recording_id, frame_idx) GROUP BY recording_id, track_id, frame_idx",
    ),
    "background_table": _with(PIXELS, "SELECT label, y, x, v_max, 2 AS built FROM proj"),
    "frame_difference": _with(PIXELS, "SELECT px.frame_idx, count(*) AS n_px FROM px JOIN proj USING (label, y, x) WHERE abs(v - v_min) > 40 GROUP BY px.frame_idx"),
    "clone_patch": _with(
        PIXELS + ", copied AS (SELECT label, frame_idx, y + 2 AS y, x + 3 AS x, v AS w FROM px WHERE (x - 2) ** 2 + (y - 2) ** 2 <= 1)",
        "SELECT px.frame_idx, px.y, px.x, coalesce(c.w, px.v) AS v FROM px LEFT JOIN copied c ON c.frame_idx = px.frame_idx AND c.y = px.y AND c.x = px.x",
    ),
    "brush_stamp": _with(
        DET + """,
stamp AS (
  SELECT DISTINCT recording_id, CAST(floor(cy_px) AS INTEGER) + dy AS y, CAST(floor(cx_px) AS INTEGER) + dx AS x FROM det, range(-4, 5) a(dy), range(-4, 5) b(dx) WHERE frame_idx % 10 = 0 AND dx * dx + dy * dy <= 16)""",
        "SELECT recording_id, count(*) AS n_px, CAST(sum(y) AS BIGINT) AS y, CAST(sum(x) AS BIGINT) AS x FROM stamp GROUP BY recording_id",
    ),
    "pose_patches": _with(PIXELS + _POSE, "SELECT frame_idx, track_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS patch FROM grey GROUP BY frame_idx, track_id"),
    "fingerprint_extract": _with(
        PIXELS + _POSE + """,
half AS (
  SELECT frame_idx, track_id, list(v ORDER BY pos) AS p, avg(v) FILTER (pos % 6 < 3) < avg(v) FILTER (pos % 6 >= 3) AS turned FROM grey GROUP BY frame_idx, track_id)""",
        "SELECT frame_idx, track_id, array_to_string(CASE WHEN turned THEN list_reverse(p) ELSE p END, ',') AS patch, 90 + 20 * (frame_idx % 3) BETWEEN 80 AND 120 AS is_confident, "
        "90.0::DOUBLE + 20 * (frame_idx % 3) AS area_px, 4 AS patch_h, 6 AS patch_w FROM half",
    ),
    "running_patch": _with(
        PIXELS + """,
med AS (
  SELECT label, frame_idx, y * 8 + x AS pos, median(v) OVER (PARTITION BY label, y, x ORDER BY frame_idx ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS m FROM px WHERE frame_idx % 3 <> 0)""",
        "SELECT label AS track_id, frame_idx, string_agg(printf('%.1f', m), ',' ORDER BY pos) AS patch FROM med GROUP BY label, frame_idx",
    ),
    "verdict_problems": _with(
        REVIEW,
        "SELECT recording_id, event_id, [NULL, NULL, 'permutation changes nothing', 'permutation repeats an id', 'permutation is not a list of ids', 'permutation changes nothing'][frame_start // 2 % 6 + 1] AS problem FROM verd",
    ),
    "summary_file": _with(
        DET, "SELECT recording_id, track_id, count(*) AS n, printf('%.4f', round(avg(cx_px), 6) + 1e-9) AS cx_px, printf('%.4f', round(avg(cy_px), 6) + 1e-9) AS cy_px FROM det GROUP BY recording_id, track_id"
    ),
    "file_hash": _with(DET, "SELECT DISTINCT recording_id, sha256('recording ' || recording_id || chr(10)) AS sha256 FROM det"),
    "tuning_params": _with(
        DET + ", rec AS (SELECT DISTINCT recording_id, CAST(recording_id[2:] AS INTEGER) AS n FROM det)",
        "SELECT recording_id, CASE WHEN n % 3 > 0 THEN 20 + n ELSE 25 END AS threshold, CASE WHEN n % 2 > 0 THEN 'chain' ELSE 'watershed' END AS splitter FROM rec",
    ),
    "roi_sidecar": _with(
        DET + ", rec AS (SELECT DISTINCT recording_id FROM det)",
        "SELECT recording_id, 0 AS place, 'add' AS operation, 'disc' AS label, 'circle' AS shape, 'r' AS geometry FROM rec UNION ALL SELECT recording_id, 1, 'subtract', 'hole', 'rectangle', recording_id FROM rec",
    ),
    "filled_labels": _with(
        DET + ", known AS (SELECT *, CASE WHEN frame_idx % 4 = 0 THEN 'roi' || frame_idx % 3 END AS l FROM det)",
        f"SELECT {_KEY}, coalesce(last_value(l IGNORE NULLS) OVER w, first_value(l IGNORE NULLS) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS roi "
        "FROM known WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY frame_idx)",
    ),
    "mask_intersection": _with(
        PIXELS,
        "SELECT px.frame_idx, count(*) AS n_px FROM px JOIN proj USING (label, y, x) WHERE v_max - v > 20 AND (x - 3.5) ** 2 + (y - 3.5) ** 2 <= 9 AND x BETWEEN 2 AND 7 AND y BETWEEN 0 AND 4 GROUP BY px.frame_idx",
    ),
    "recording_meta": _with(
        DET + ", scaled AS (SELECT *, CAST(recording_id[2:] AS INTEGER) AS n FROM det)",
        f"SELECT {_KEY}, round(cx_px / CASE WHEN n % 2 = 0 THEN 2.0::DOUBLE + n % 4 ELSE 8 END, 6) AS x_mm, round(frame_idx / CASE WHEN n % 2 = 0 THEN 20.0::DOUBLE + n % 5 ELSE 25 END, 6) AS seconds FROM scaled",
    ),
}
