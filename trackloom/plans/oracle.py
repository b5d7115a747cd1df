"""SQL for the registered trajectory queries, for an engine that knows nothing of the library.

Statements share named parts: each starts from ``det``, the detections that the adapter makes.
"""

from __future__ import annotations

import math

# Least-squares parabolas over 5 and 7 places. A row holds the weights of the fit at a
# place of the window; the rows after the middle are those before it, turned round.
_FIVE = [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3]]
_SEVEN = [[32, 15, 3, -4, -6, -3, 5], [15, 12, 9, 6, 3, 0, -3], [3, 9, 12, 12, 9, 3, -6], [-4, 6, 12, 14, 12, 6, -4]]
FITS = {
    (len(rows[0]), 2): [[v / whole for v in r] for r in [*rows, *(r[::-1] for r in rows[-2::-1])]] for rows, whole in ((_FIVE, 35), (_SEVEN, 42))
}

DET = """det AS (
  SELECT 'r' || (user_id // 4) AS recording_id, CAST(user_id % 4 AS INTEGER) AS track_id,
         CAST(n + (n + user_id % 4) // 5 + 4 * ((n + 3 * (user_id % 4)) // 23) AS BIGINT) AS frame_idx,
         value AS cx_px, k * 4.0::DOUBLE AS cy_px, CAST(k * 7 % 180 AS DOUBLE) AS orientation_deg,
         CAST(k + 100 AS DOUBLE) AS area_px, CAST(k + 20 AS DOUBLE) AS major_axis_px, CAST(k % 10 + 10 AS DOUBLE) AS minor_axis_px
  FROM (SELECT user_id, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events))"""

PAIRS = DET + """,
pair AS (
  SELECT a.recording_id, a.frame_idx, a.track_id AS track_i, b.track_id AS track_j, sqrt((a.cx_px - b.cx_px) ** 2 + (a.cy_px - b.cy_px) ** 2) AS d
  FROM det a JOIN det b ON a.recording_id = b.recording_id AND a.frame_idx = b.frame_idx AND a.track_id < b.track_id),
grid AS (SELECT f.recording_id, f.frame_idx, t.track_id FROM (SELECT DISTINCT recording_id, frame_idx FROM det) f JOIN (SELECT DISTINCT recording_id, track_id FROM det) t USING (recording_id))"""

NN = PAIRS + """,
ends AS (SELECT recording_id, frame_idx, track_i AS track_id, d FROM pair UNION ALL SELECT recording_id, frame_idx, track_j, d FROM pair),
nn AS (
  SELECT grid.recording_id, grid.track_id, grid.frame_idx, least_d.d / 10 AS nn_mm
  FROM grid LEFT JOIN (SELECT recording_id, frame_idx, track_id, min(d) AS d FROM ends GROUP BY ALL) least_d USING (recording_id, frame_idx, track_id)
  WHERE grid.recording_id IN (SELECT recording_id FROM det GROUP BY recording_id HAVING count(DISTINCT track_id) > 1))"""

POL = """pol AS (
  SELECT recording_id, frame_idx, count(*) AS n_headings,
         CASE WHEN count(*) >= 2 THEN sqrt(sum(cos(radians(orientation_deg))) ** 2 + sum(sin(radians(orientation_deg))) ** 2) / count(*) END AS polarisation
  FROM det GROUP BY recording_id, frame_idx)"""

DENSE = DET + """,
dense AS (
  SELECT s.recording_id, s.track_id, s.frame_idx, d.track_id IS NOT NULL AS observed, d.cx_px, d.cy_px, d.orientation_deg
  FROM (SELECT recording_id, track_id, unnest(generate_series(min(frame_idx), max(frame_idx))) AS frame_idx FROM det GROUP BY recording_id, track_id) s
  LEFT JOIN det d USING (recording_id, track_id, frame_idx))"""


def _runs(source: str, column: str, name: str) -> str:
    """Numbered runs of rows with and without a value."""
    return f"""{name}_c AS (
  SELECT *, CASE WHEN ({column} IS NULL) <> lag({column} IS NULL) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx) THEN 1 ELSE 0 END AS ch FROM {source}),
{name} AS (SELECT * EXCLUDE (ch), sum(ch) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx) AS run FROM {name}_c)"""


def _gradient(column: str, scale: float) -> str:
    w = "OVER (PARTITION BY recording_id, track_id, run ORDER BY frame_idx)"
    return (
        f"CASE WHEN lag({column}) {w} IS NULL THEN lead({column}) {w} - {column} WHEN lead({column}) {w} IS NULL THEN {column} - lag({column}) {w} "
        f"ELSE (lead({column}) {w} - lag({column}) {w}) / 2 END * {scale}"
    )


def _smooth(column: str, window: int, degree: int) -> str:
    """The polynomial fit over a run, as sums over neighbours; i and n are a row's place in its run and the run's length."""
    hat, half, w = FITS[window, degree], window // 2, "OVER (PARTITION BY recording_id, track_id, run ORDER BY frame_idx)"
    dot = lambda row, first: " + ".join(f"({hat[row][j]!r}::DOUBLE) * lead({column}, {j + first}) {w}" for j in range(window))
    cases = "".join(
        f" WHEN i = {i} THEN {dot(i, -i)} WHEN i = n - 1 - {i} THEN {dot(window - 1 - i, i - window + 1)}" for i in range(half)
    )
    return f"CASE WHEN {column} IS NULL OR n < {window} THEN {column}{cases} ELSE {dot(half, -half)} END"


_PLACES = "SELECT *, row_number() OVER (PARTITION BY recording_id, track_id, run ORDER BY frame_idx) - 1 AS i, count(*) OVER (PARTITION BY recording_id, track_id, run) AS n FROM"

MOVING = DENSE + ",\n" + _runs("dense", "cx_px", "ran") + f""",
moving AS (
  SELECT *, sqrt(vx_mm_s ** 2 + vy_mm_s ** 2) AS speed_mm_s
  FROM (SELECT *, {_gradient('cx_px', 0.1)} AS vx_mm_s, {_gradient('cy_px', 0.1)} AS vy_mm_s FROM ran))"""

SPEED = """speed AS (
  SELECT recording_id, track_id, median(speed_mm_s) AS speed_median_mm_s, quantile_cont(speed_mm_s, 0.9) AS speed_p90_mm_s, max(speed_mm_s) AS speed_max_mm_s,
         sum(speed_mm_s) AS path_length_mm FROM moving GROUP BY recording_id, track_id)"""


def _bouts(on: float, off: float, least: float) -> str:
    return f"""sig AS (SELECT *, CASE WHEN speed_mm_s > {on} THEN 1 WHEN speed_mm_s < {off} THEN 0 END AS s FROM moving),
held AS (
  SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0) AS active,
         row_number() OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx) AS rn FROM sig),
isle AS (SELECT *, rn - row_number() OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx) AS g FROM held WHERE active = 1),
bout AS (
  SELECT recording_id, track_id, min(frame_idx) AS frame_start, max(frame_idx) AS frame_end, CAST(count(*) AS DOUBLE) AS duration_s, avg(speed_mm_s) AS mean_speed_mm_s
  FROM isle GROUP BY recording_id, track_id, g HAVING count(*) >= {least}),
bouts_of AS (
  SELECT t.recording_id, t.track_id, t.n AS total_time_s, coalesce(b.n, 0) AS n_walk_bouts, coalesce(b.s, 0) AS walking_time_s
  FROM (SELECT recording_id, track_id, CAST(count(*) AS DOUBLE) AS n FROM moving GROUP BY recording_id, track_id) t
  LEFT JOIN (SELECT recording_id, track_id, count(*) AS n, sum(duration_s) AS s FROM bout GROUP BY recording_id, track_id) b USING (recording_id, track_id))"""


OUT = """valid AS (
  SELECT *, row_number() OVER w AS j,
         coalesce(sqrt((cx_px - lag(cx_px) OVER w) ** 2 + (cy_px - lag(cy_px) OVER w) ** 2) / (frame_idx - lag(frame_idx) OVER w) * 0.1 > 20, false) AS fast
  FROM det WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY frame_idx)),
flagged AS (
  SELECT *, fast AND (j - max(CASE WHEN NOT fast THEN j END) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx)) % 2 = 1 AS outlier_rejected FROM valid)"""


def _interp(source: str, column: str, gap: int) -> str:
    back = "OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    f0, f1 = (f"{fn}(CASE WHEN {column} IS NOT NULL THEN frame_idx END IGNORE NULLS) {w}" for fn, w in (("last_value", back), ("first_value", ahead)))
    v0, v1 = (f"{fn}({column} IGNORE NULLS) {w}" for fn, w in (("last_value", back), ("first_value", ahead)))
    return f"coalesce({column}, CASE WHEN {f1} - {f0} - 1 <= {gap} THEN {v0} + ({v1} - {v0}) * (frame_idx - {f0}) / ({f1} - {f0}) END)"


CLEAN = DET + ",\n" + OUT + f""",
dense AS (
  SELECT s.recording_id, s.track_id, s.frame_idx, d.track_id IS NULL AS interpolated, coalesce(d.outlier_rejected, false) AS outlier_rejected,
         CASE WHEN NOT d.outlier_rejected THEN d.cx_px END AS cx0, CASE WHEN NOT d.outlier_rejected THEN d.cy_px END AS cy0
  FROM (SELECT recording_id, track_id, unnest(generate_series(min(frame_idx), max(frame_idx))) AS frame_idx FROM det GROUP BY recording_id, track_id) s
  LEFT JOIN flagged d USING (recording_id, track_id, frame_idx)),
filled AS (SELECT *, {_interp('dense', 'cx0', 2)} AS cx_px, {_interp('dense', 'cy0', 2)} AS cy_px FROM dense),
{_runs('filled', 'cx_px', 'ran')},
placed AS ({_PLACES} ran),
smoothed AS (SELECT *, {_smooth('cx_px', 5, 2)} AS cx_smooth_px, {_smooth('cy_px', 5, 2)} AS cy_smooth_px FROM placed),
kin AS (SELECT *, {_gradient('cx_smooth_px', 0.1)} AS vx, {_gradient('cy_smooth_px', 0.1)} AS vy FROM smoothed)"""

EVENTS = PAIRS + """,
ranks AS (SELECT recording_id, frame_idx, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) - 1 AS rank FROM (SELECT DISTINCT recording_id, frame_idx FROM det)),
frames AS (
  SELECT r.recording_id, r.frame_idx, r.rank, p.d AS min_px, c.n < t.n AS missing, coalesce(p.d <= {contact}, false) AS contact
  FROM ranks r LEFT JOIN (SELECT recording_id, frame_idx, min(d) AS d FROM pair GROUP BY recording_id, frame_idx) p USING (recording_id, frame_idx)
  JOIN (SELECT recording_id, frame_idx, count(*) AS n FROM det GROUP BY recording_id, frame_idx) c USING (recording_id, frame_idx) JOIN (SELECT recording_id, count(DISTINCT track_id) AS n FROM det GROUP BY recording_id) t USING (recording_id))"""


def _blocks(event: str, gap: int) -> str:
    return f"""ev AS (SELECT *, CASE WHEN rank - lag(rank) OVER (PARTITION BY recording_id ORDER BY rank) > {gap} THEN 1 ELSE 0 END AS ch FROM frames WHERE {event}),
sess AS (SELECT *, sum(ch) OVER (PARTITION BY recording_id ORDER BY rank) AS block FROM ev),
span AS (
  SELECT recording_id, block, min(rank) AS rank_start, max(rank) AS rank_end, min(frame_idx) AS frame_start, max(frame_idx) AS frame_end FROM sess GROUP BY recording_id, block),
mean_pair AS (
  SELECT s.recording_id, s.block, p.track_i, p.track_j, avg(p.d) AS mean_px, min(p.d) AS min_px
  FROM span s JOIN ranks r ON r.recording_id = s.recording_id AND r.rank BETWEEN s.rank_start AND s.rank_end
  JOIN pair p ON p.recording_id = r.recording_id AND p.frame_idx = r.frame_idx GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY recording_id, block ORDER BY mean_px, track_i, track_j) AS rn FROM mean_pair),
blocks AS (
  SELECT s.*, coalesce(b.track_i, 0) AS animal_a, coalesce(b.track_j, 1) AS animal_b, b.min_px AS min_distance_px,
         concat_ws('-', s.frame_start, coalesce(b.track_i, 0), coalesce(b.track_j, 1)) AS event_id
  FROM span s LEFT JOIN best b ON b.recording_id = s.recording_id AND b.block = s.block AND b.rn = 1)"""


BLOCKS = EVENTS.format(contact=10) + ",\n" + _blocks("contact", 2)
REVIEW = BLOCKS + """,
cand AS (SELECT *, CASE WHEN frame_start % 3 = 0 THEN 'jump' ELSE 'contact' END AS source, min_distance_px * 2 AS max_jump_px FROM blocks),
verd AS (SELECT *, ['accept_swap', 'reject_swap', 'mount', 'unknown'][frame_start % 4 + 1] AS verdict FROM cand WHERE frame_start % 2 = 0),
log AS (SELECT *, CASE WHEN frame_start % 9 = 0 THEN 'mount' ELSE 'auto' END AS verdict FROM cand WHERE frame_start % 3 = 0)"""


def _merged(which: str) -> str:
    return f"""merged AS (
  SELECT b.recording_id, b.event_id, b.frame_start, b.frame_end, b.animal_a, b.animal_b, c.min_distance_px, c.max_jump_px,
         concat_ws(',', c.source, CASE WHEN l.event_id IS NOT NULL THEN 'audit' END, CASE WHEN v.event_id IS NOT NULL THEN 'verdict' END) AS sources,
         CASE WHEN l.event_id IS NOT NULL THEN 10.0::DOUBLE END AS cost_before, CASE WHEN l.event_id IS NOT NULL THEN 4.0::DOUBLE END AS cost_after,
         coalesce(l.verdict <> 'mount', false) AS audit_committed, v.verdict,
         coalesce(v.verdict, CASE WHEN l.verdict <> 'mount' THEN 'auto_swap' END, 'pending') AS status
  FROM blocks b LEFT JOIN (SELECT * FROM cand WHERE {which}) c USING (recording_id, event_id) LEFT JOIN log l USING (recording_id, event_id) LEFT JOIN verd v USING (recording_id, event_id)
  WHERE c.event_id IS NOT NULL OR l.event_id IS NOT NULL OR v.event_id IS NOT NULL)"""


PATCH = """patch AS (
  SELECT vec_id, label AS track_id, list_transform(embedding, lambda v: CAST(floor(least(greatest(round(CAST(v AS FLOAT) * 100 + 128), 0), 255)) AS INTEGER)) AS p FROM embeddings)"""
PIXELS = PATCH + """,
px AS (SELECT track_id AS label, vec_id AS frame_idx, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, p[i] AS v FROM patch, (SELECT unnest(generate_series(1, 64)) AS i)),
proj AS (SELECT label, y, x, max(v) AS v_max, min(v) AS v_min FROM px GROUP BY ALL),
fg AS (SELECT px.frame_idx, px.y, px.x FROM px JOIN proj USING (label, y, x) WHERE v_max - v > 40)"""


def _offsets() -> str:
    """A place and its four neighbours: the elliptical kernel of size 3."""
    return "(VALUES (-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)) o(dy, dx)"


def _dilate(source: str) -> str:
    return f"(SELECT DISTINCT frame_idx, y + dy AS y, x + dx AS x FROM {source}, {_offsets()})"


def _erode(source: str) -> str:
    return f"(SELECT frame_idx, y - dy AS y, x - dx AS x FROM {source}, {_offsets()} GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM {_offsets()}))"


def _circ(a: str, b: str) -> str:
    m = f"((({a}) - ({b})) % 360 + 360) % 360"
    return f"least({m}, 360 - {m})"


def _turn(a: str, b: str) -> str:
    return f"CASE WHEN {_circ(a, b)} <= 90 THEN 0.0 ELSE ({_circ(a, b)} - 90) / 90 * 90.0 END"


_COSTS = (
    "c AS cand0, CASE WHEN speed_mm_s >= 1 THEN {lean} ELSE 0 END AS lean, CASE WHEN b IS NULL THEN 0 ELSE {stay} END AS stay, CASE WHEN b IS NULL THEN 0 ELSE {turn} END AS turn"
).format(lean=f"{_circ('c', 't')} - {_circ('c + 180', 't')}", stay=_turn("c", "b"), turn=_turn("c + 180", "b"))

COSTS = MOVING + f""",
cand AS (
  SELECT *, orientation_deg AS c, lag(orientation_deg) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx) AS b, (degrees(atan2(vy_mm_s, vx_mm_s)) + 360) % 360 AS t
  FROM moving WHERE orientation_deg IS NOT NULL),
costs AS (SELECT recording_id, track_id, frame_idx, row_number() OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx) AS i, count(*) OVER (PARTITION BY recording_id, track_id) AS n, {_COSTS} FROM cand)"""

_FILL = (
    "coalesce(last_value({0} IGNORE NULLS) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "first_value({0} IGNORE NULLS) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
)

HEADING = "RECURSIVE " + COSTS + f""",
fwd(recording_id, track_id, i, d) AS (
  SELECT recording_id, track_id, i, CAST(lean AS DOUBLE) FROM costs WHERE i = 1
  UNION ALL
  SELECT c.recording_id, c.track_id, c.i, c.lean + least(greatest(f.d, -greatest(c.stay, c.turn)), greatest(c.stay, c.turn)) * CASE WHEN c.stay = 0 THEN 1 ELSE -1 END
  FROM fwd f JOIN costs c ON c.recording_id = f.recording_id AND c.track_id = f.track_id AND c.i = f.i + 1),
bwd(recording_id, track_id, i, s) AS (
  SELECT f.recording_id, f.track_id, f.i, CASE WHEN f.d <= 0 THEN 0 ELSE 1 END FROM fwd f JOIN costs c USING (recording_id, track_id, i) WHERE c.i = c.n
  UNION ALL
  SELECT f.recording_id, f.track_id, f.i, CASE WHEN f.d + CASE WHEN b.s = 0 THEN c.stay ELSE c.turn END > CASE WHEN b.s = 0 THEN c.turn ELSE c.stay END THEN 1 ELSE 0 END
  FROM bwd b JOIN costs c USING (recording_id, track_id, i) JOIN fwd f ON f.recording_id = b.recording_id AND f.track_id = b.track_id AND f.i = b.i - 1),
turned AS (
  SELECT d.recording_id, d.track_id, d.frame_idx, (c.cand0 + 180 * b.s) % 360 AS h, c.lean
  FROM dense d LEFT JOIN costs c USING (recording_id, track_id, frame_idx) LEFT JOIN bwd b USING (recording_id, track_id, i)),
head AS (
  SELECT recording_id, track_id, frame_idx, {_FILL.format('h')} AS heading_deg, NOT bool_or(coalesce(lean, 0) <> 0) OVER (PARTITION BY recording_id, track_id) AS heading_unresolved FROM turned)"""

YAW = HEADING + f""",
unit AS (
  SELECT *, 0 AS run, cos(radians(heading_deg)) AS c, sin(radians(heading_deg)) AS s, row_number() OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx) - 1 AS i,
         count(*) OVER (PARTITION BY recording_id, track_id) AS n FROM head),
fitted AS (SELECT recording_id, track_id, frame_idx, run, atan2({_smooth('s', 7, 2)}, {_smooth('c', 7, 2)}) AS a FROM unit),
diffs AS (SELECT *, a - lag(a) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx) AS d FROM fitted),
wraps AS (SELECT *, ((d + {math.pi!r}) % {2 * math.pi!r} + {2 * math.pi!r}) % {2 * math.pi!r} - {math.pi!r} AS w FROM diffs),
yawed AS (
  SELECT *, degrees(first_value(a) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx)
         + sum(coalesce(CASE WHEN w = -{math.pi!r} AND d > 0 THEN {math.pi!r} ELSE w END, 0)) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx)) AS yaw_deg FROM wraps)"""


def _edges(vertices: list[tuple[float, float]]):
    return list(zip(vertices, [*vertices[1:], vertices[0]]))


def _segment(p: tuple[float, float], q: tuple[float, float]) -> str:
    dx, dy = q[0] - p[0], q[1] - p[1]
    t = f"least(greatest(((cx_px - {p[0]}) * {dx} + (cy_px - {p[1]}) * {dy}) / {dx * dx + dy * dy}, 0), 1)"
    return f"sqrt((cx_px - ({p[0]} + {t} * {dx})) ** 2 + (cy_px - ({p[1]} + {t} * {dy})) ** 2)"


_BOX = [(0.0, 0.0), (490.0, 0.0), (490.0, 400.0), (0.0, 400.0)]
_WALL = f"least({', '.join(_segment(p, q) for p, q in _edges(_BOX))})"

_TRIANGLE = [(10.0, 10.0), (90.0, 15.0), (40.0, 80.0)]
_CROSS = " + ".join(
    f"CASE WHEN ({y0} > cy_px) <> ({y1} > cy_px) AND cx_px < {x1 - x0} * (cy_px - {y0}) / {y1 - y0} + {x0} THEN 1 ELSE 0 END"
    for (x0, y0), (x1, y1) in _edges(_TRIANGLE)
)
_IN_TRIANGLE = f"(({_CROSS}) % 2 = 1 OR least({', '.join(_segment(p, q) for p, q in _edges(_TRIANGLE))}) < 1e-9)"
_IN_DISC = "((cx_px - 245) ** 2 + (cy_px - 200) ** 2 <= 32400)"
_IN_HOLE = "(cx_px BETWEEN 200 AND 260 AND cy_px BETWEEN 150 AND 260)"

_KALMAN_1 = {"pxx": 1 + 100 + 0.25, "pxv": 100.0, "pvv": 100 + 0.25}
_S1 = _KALMAN_1["pxx"] + 1
_KX, _KV = _KALMAN_1["pxx"] / _S1, _KALMAN_1["pxv"] / _S1
_P2 = (1 - _KX) * _KALMAN_1["pxx"] + 2 * (1 - _KX) * _KALMAN_1["pxv"] + (_KALMAN_1["pvv"] - _KV * _KALMAN_1["pxv"]) + 0.25

_REF = DET + """,
good AS (
  SELECT *, major_axis_px / minor_axis_px AS axis_ratio, median(area_px) OVER w AS median_area_px, median(major_axis_px / minor_axis_px) OVER w AS median_axis_ratio
  FROM det WHERE frame_idx % 3 <> 0 WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY frame_idx ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))"""

_RMSE = "sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: CAST((a[i] - {b}) ** 2 AS DOUBLE))) / 64)"


def _with(parts: str, rest: str) -> str:
    return f"WITH {parts}\n{rest}"


_R = lambda *columns: ", ".join(f"round({c}, 6) AS {c}" for c in columns)

SQL: dict[str, str] = {
    "detections_adapter": _with(DET, "SELECT recording_id, track_id, frame_idx, cx_px, cy_px, orientation_deg FROM det"),
    "world_projection": _with(DET, "SELECT recording_id, track_id, frame_idx, round((cx_px - 245) * 0.1 * -1, 6) + 0.0 AS x_mm, round((cy_px - 200) * 0.1 * -1, 6) + 0.0 AS y_mm FROM det"),
    "trim_stride_filter": _with(DET, "SELECT recording_id, track_id, frame_idx, cx_px, cy_px FROM det WHERE frame_idx >= 12 AND frame_idx < 60 AND (frame_idx - 12) % 3 = 0"),
    "pairwise_distance": _with(PAIRS, "SELECT recording_id, frame_idx, track_i, track_j, round(d / 10, 6) AS distance_mm FROM pair"),
    "nn_distance": _with(NN, f"SELECT recording_id, track_id, frame_idx, {_R('nn_mm')} FROM nn"),
    "nn_summary": _with(NN, "SELECT recording_id, track_id, round(avg(nn_mm), 6) AS nn_mean_mm, round(quantile_cont(nn_mm, 0.1), 6) AS nn_p10_mm FROM nn GROUP BY recording_id, track_id"),
    "polarisation": _with(DET + ",\n" + POL, f"SELECT recording_id, frame_idx, n_headings, {_R('polarisation')} FROM pol"),
    "group_series": _with(
        NN + ",\n" + POL,
        "SELECT recording_id, frame_idx, round(max(nn_mm) FILTER (track_id = 0), 6) AS nn_track_0_mm, round(max(nn_mm) FILTER (track_id = 1), 6) AS nn_track_1_mm, "
        "round(max(nn_mm) FILTER (track_id = 2), 6) AS nn_track_2_mm, round(max(nn_mm) FILTER (track_id = 3), 6) AS nn_track_3_mm, round(any_value(polarisation), 6) AS polarisation FROM nn FULL JOIN pol USING (recording_id, frame_idx) GROUP BY recording_id, frame_idx",
    ),
    "nearest_sample": _with(DET, "SELECT recording_id, track_id, frame_idx, round((cx_px - 245) * (cx_px - 245) + (cy_px - 200) * (cy_px - 200), 6) AS d2 FROM det QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY (cx_px - 245) * (cx_px - 245) + (cy_px - 200) * (cy_px - 200), track_id, frame_idx) = 1"),
    "speed_summary": _with(MOVING + ",\n" + SPEED, f"SELECT recording_id, track_id, {_R('speed_median_mm_s', 'speed_p90_mm_s', 'speed_max_mm_s', 'path_length_mm')} FROM speed"),
    "bouts": _with(MOVING + ",\n" + _bouts(8, 4, 2), f"SELECT recording_id, track_id, frame_start, frame_end, {_R('duration_s', 'mean_speed_mm_s')} FROM bout"),
    "bout_summary": _with(
        MOVING + ",\n" + _bouts(8, 4, 2),
        f"SELECT recording_id, track_id, n_walk_bouts, {_R('total_time_s', 'walking_time_s')}, round(walking_time_s / total_time_s, 6) AS walking_fraction FROM bouts_of",
    ),
    "occupancy": _with(
        DET,
        "SELECT recording_id, CAST(least(floor(cy_px * 16 / 400), 15) AS INTEGER) AS ybin, CAST(least(floor(cx_px * 16 / 490), 15) AS INTEGER) AS xbin, "
        "round(count(*) / sum(count(*)) OVER (PARTITION BY recording_id), 6) AS p FROM det WHERE cx_px BETWEEN 0 AND 490 AND cy_px BETWEEN 0 AND 400 GROUP BY 1, 2, 3",
    ),
    "thigmotaxis": _with(DET, "SELECT recording_id, track_id, round(avg(CASE WHEN sqrt((cx_px - 245) ** 2 + (cy_px - 200) ** 2) > 180.0 * (1 - 0.2) THEN 1.0 ELSE 0.0 END), 6) AS thigmotaxis_fraction FROM det GROUP BY recording_id, track_id"),
    "wall_distance_circle": _with(DET, "SELECT recording_id, track_id, frame_idx, round((180 - sqrt((cx_px - 245) ** 2 + (cy_px - 200) ** 2)) / 10, 6) AS wall_mm FROM det"),
    "wall_distance_polygon": _with(
        DET, f"SELECT recording_id, track_id, frame_idx, round(CASE WHEN cx_px > 0 AND cx_px < 490 AND cy_px > 0 AND cy_px < 400 THEN {_WALL} ELSE -{_WALL} END / 10, 6) + 0.0 AS wall_mm FROM det"
    ),
    "track_summary": _with(
        MOVING + ",\n" + SPEED + ",\n" + _bouts(2.5, 1, 0.1) + """,
mpairs AS (SELECT a.recording_id, a.frame_idx, a.track_id, sqrt((a.cx_px - b.cx_px) ** 2 + (a.cy_px - b.cy_px) ** 2) / 10 AS d FROM det a JOIN det b ON a.recording_id = b.recording_id AND a.frame_idx = b.frame_idx AND a.track_id <> b.track_id),
mnn AS (SELECT recording_id, track_id, avg(d) AS nn_mean_mm, quantile_cont(d, 0.1) AS nn_p10_mm FROM (SELECT recording_id, frame_idx, track_id, min(d) AS d FROM mpairs GROUP BY ALL) GROUP BY recording_id, track_id),
thig AS (SELECT recording_id, track_id, avg(CASE WHEN sqrt((cx_px - 245) ** 2 + (cy_px - 200) ** 2) > 180.0 * (1 - 0.2) THEN 1.0 ELSE 0.0 END) AS thigmotaxis_fraction FROM det GROUP BY recording_id, track_id)""",
        "SELECT recording_id, track_id, CAST(total_time_s AS BIGINT) AS n_frames, n_walk_bouts, "
        + _R("speed_median_mm_s", "speed_p90_mm_s", "speed_max_mm_s", "path_length_mm", "total_time_s", "walking_time_s", "thigmotaxis_fraction", "nn_mean_mm", "nn_p10_mm")
        + ", round(walking_time_s / total_time_s, 6) AS walking_fraction FROM speed JOIN bouts_of USING (recording_id, track_id) JOIN thig USING (recording_id, track_id) LEFT JOIN mnn USING (recording_id, track_id)",
    ),
    "densify": _with(DENSE, "SELECT recording_id, track_id, frame_idx, observed, cx_px, cy_px FROM dense"),
    "outlier_flags": _with(DET + ",\n" + OUT, "SELECT recording_id, track_id, frame_idx, outlier_rejected FROM flagged"),
    "gap_interp": _with(DENSE, f"SELECT recording_id, track_id, frame_idx, round({_interp('dense', 'cx_px', 2)}, 6) AS cx_px, round({_interp('dense', 'cy_px', 2)}, 6) AS cy_px FROM dense"),
    "sg_smooth": _with(
        DENSE + ",\n" + _runs("dense", "cx_px", "ran") + f",\nplaced AS ({_PLACES} ran)", f"SELECT recording_id, track_id, frame_idx, round({_smooth('cx_px', 5, 2)}, 6) AS cx_smooth_px FROM placed"
    ),
    "gradient_speed": _with(MOVING, f"SELECT recording_id, track_id, frame_idx, {_R('vx_mm_s', 'vy_mm_s', 'speed_mm_s')} FROM moving"),
    "clean_track": _with(
        CLEAN, f"SELECT recording_id, track_id, frame_idx, interpolated, outlier_rejected, {_R('cx_px', 'cy_px', 'cx_smooth_px', 'cy_smooth_px')}, round(sqrt(vx ** 2 + vy ** 2), 6) AS speed_mm_s FROM kin"
    ),
    "yaw_unwrap": _with(
        DET + f""",
step AS (
  SELECT *, radians(orientation_deg * 2) AS a, radians(orientation_deg * 2) - lag(radians(orientation_deg * 2)) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx) AS d FROM det),
wrapped AS (SELECT *, ((d + {math.pi!r}) % {2 * math.pi!r} + {2 * math.pi!r}) % {2 * math.pi!r} - {math.pi!r} AS w FROM step)""",
        f"SELECT recording_id, track_id, frame_idx, round(first_value(a) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx) + sum(coalesce(CASE WHEN w = -{math.pi!r} AND d > 0 THEN {math.pi!r} ELSE w END, 0)) "
        "OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx), 6) AS yaw_rad FROM wrapped",
    ),
    "heading_costs": _with(COSTS, "SELECT recording_id, track_id, frame_idx, " + _R("cand0", "lean", "stay", "turn") + " FROM costs"),
    "heading_viterbi": _with(HEADING, f"SELECT recording_id, track_id, frame_idx, heading_unresolved, {_R('heading_deg')} FROM head"),
    "yaw": _with(YAW, f"SELECT recording_id, track_id, frame_idx, {_R('yaw_deg')}, round({_gradient('yaw_deg', 1.0)}, 6) AS yaw_rate_deg_s FROM yawed"),
    "yaw_summary": _with(
        DET,
        "SELECT recording_id, track_id, round(median(abs(orientation_deg - 90)), 6) AS yaw_rate_median_abs_deg_s, round(quantile_cont(abs(orientation_deg - 90), 0.95), 6) AS yaw_rate_p95_abs_deg_s FROM det GROUP BY recording_id, track_id",
    ),
    "event_frames": _with(EVENTS.format(contact=20), f"SELECT recording_id, frame_idx, rank, missing, contact, contact OR missing AS event, {_R('min_px')} FROM frames"),
    "event_blocks": _with(BLOCKS, f"SELECT recording_id, rank_start, rank_end, frame_start, frame_end, animal_a, animal_b, event_id, {_R('min_distance_px')} FROM blocks"),
    "candidates": _with(
        EVENTS.format(contact=10) + """,
place AS (SELECT g.recording_id, g.track_id, g.frame_idx, d.cx_px AS x, d.cy_px AS y FROM grid g LEFT JOIN det d USING (recording_id, track_id, frame_idx)),
stepped AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 THEN x - x ELSE sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) END AS step
  FROM place WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY frame_idx)),
jumps AS (SELECT recording_id, frame_idx, bool_or(coalesce(step > 400, false)) AS jump FROM stepped GROUP BY recording_id, frame_idx),
flags AS (SELECT f.*, j.jump FROM frames f JOIN jumps j USING (recording_id, frame_idx)),
""" + _blocks("contact OR missing OR jump", 3).replace("FROM frames WHERE", "FROM flags WHERE") + """,
inside AS (
  SELECT b.recording_id, b.block, bool_or(f.contact) AS c, bool_or(f.jump) AS j, CAST(count(*) AS INTEGER) AS n_frames FROM blocks b JOIN flags f ON f.recording_id = b.recording_id AND f.rank BETWEEN b.rank_start AND b.rank_end GROUP BY b.recording_id, b.block),
moved AS (
  SELECT b.recording_id, b.block, max(s.step) AS max_jump_px FROM blocks b JOIN ranks r ON r.recording_id = b.recording_id AND r.rank BETWEEN b.rank_start AND b.rank_end
  JOIN stepped s ON s.recording_id = r.recording_id AND s.frame_idx = r.frame_idx AND s.track_id IN (b.animal_a, b.animal_b) GROUP BY b.recording_id, b.block)""",
        "SELECT recording_id, event_id, frame_start, frame_end, animal_a, animal_b, CASE WHEN c AND j THEN 'contact,jump' WHEN j THEN 'jump' ELSE 'contact' END AS source, n_frames, "
        + _R("min_distance_px", "max_jump_px")
        + " FROM blocks JOIN inside USING (recording_id, block) LEFT JOIN moved USING (recording_id, block)",
    ),
    "trace_segments": _with(
        DET + """,
cut AS (
  SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER w > 3 OR sqrt((cx_px - lag(cx_px) OVER w) ** 2 + (cy_px - lag(cy_px) OVER w) ** 2) > 250 THEN 1 ELSE 0 END AS c
  FROM det WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY frame_idx))""",
        "SELECT recording_id, track_id, frame_idx, CAST(sum(c) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx) AS BIGINT) AS segment FROM cut",
    ),
    "polylines": _with(
        DET + """,
cut AS (
  SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER w > 3 OR sqrt((cx_px - lag(cx_px) OVER w) ** 2 + (cy_px - lag(cy_px) OVER w) ** 2) > 250 THEN 1 ELSE 0 END AS c
  FROM det WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY frame_idx)),
seg AS (SELECT recording_id, track_id, frame_idx, CAST(sum(c) OVER (PARTITION BY recording_id, track_id ORDER BY frame_idx) AS BIGINT) AS segment FROM cut)""",
        "SELECT recording_id, track_id, segment, count(*) AS n_points, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame FROM seg GROUP BY ALL HAVING count(*) >= 2",
    ),
    "trail": _with(
        DET + """,
near AS (
  SELECT *, lead(cx_px) OVER w AS x1, lead(cy_px) OVER w AS y1, lead(frame_idx) OVER w AS f1 FROM det WHERE frame_idx BETWEEN 16 AND 40
  WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY frame_idx))""",
        "SELECT recording_id, track_id, frame_idx, round(cx_px, 6) AS x0, round(cy_px, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(greatest(0.1, 1 - (40 - f1) / 24), 6) AS alpha FROM near WHERE f1 - frame_idx <= 5",
    ),
    "review_merge": _with(
        REVIEW + ",\n" + _merged("frame_start % 5 <> 0"),
        f"SELECT recording_id, event_id, frame_start, frame_end, animal_a, animal_b, sources, cost_before, cost_after, audit_committed, verdict, status, {_R('min_distance_px', 'max_jump_px')} FROM merged",
    ),
    "review_totals": _with(REVIEW + ",\n" + _merged("true"), "SELECT count(*) AS total, count(verdict) AS done, count(*) - count(verdict) AS pending FROM merged"),
    "verdict_upsert": _with(REVIEW, "SELECT recording_id, event_id, CASE WHEN frame_start % 4 = 0 THEN 'reject_swap' ELSE verdict END AS verdict, frame_start FROM verd"),
    "event_id_codec": _with(REVIEW, "SELECT recording_id, event_id, animal_a AS a, animal_b AS b FROM cand"),
    "mount_tag": _with(
        REVIEW,
        "SELECT d.recording_id, d.track_id, d.frame_idx, CASE WHEN EXISTS (SELECT 1 FROM verd v WHERE v.recording_id = d.recording_id AND v.verdict = 'mount' AND d.frame_idx BETWEEN v.frame_start AND v.frame_end AND d.track_id IN (v.animal_a, v.animal_b)) THEN 'mount' ELSE '' END AS event_type FROM det d",
    ),
    "mount_filter": _with(
        REVIEW,
        "SELECT d.recording_id, d.track_id, d.frame_idx, d.cx_px FROM det d WHERE NOT EXISTS (SELECT 1 FROM verd v WHERE v.recording_id = d.recording_id AND v.verdict = 'mount' AND d.frame_idx BETWEEN v.frame_start AND v.frame_end AND d.track_id IN (v.animal_a, v.animal_b))",
    ),
    "kalman_mahalanobis": _with(
        DET + """,
lagged AS (
  SELECT *, lag(cx_px) OVER w AS x1, lag(cy_px) OVER w AS y1, lag(cx_px, 2) OVER w AS x2, lag(cy_px, 2) OVER w AS y2 FROM det WINDOW w AS (PARTITION BY recording_id, track_id ORDER BY frame_idx))""",
        f"SELECT recording_id, track_id, frame_idx, round(((cx_px - (x2 + {_KX + _KV!r}::DOUBLE * (x1 - x2))) ** 2 + (cy_px - (y2 + {_KX + _KV!r}::DOUBLE * (y1 - y2))) ** 2) / {_P2 + 1!r}::DOUBLE, 6) AS d2 FROM lagged WHERE x2 IS NOT NULL",
    ),
    "patch_rmse_flip": _with(
        PATCH + ",\nnext_to AS (SELECT p.vec_id, p.p AS a, q.p AS b FROM patch p JOIN patch q ON q.vec_id = p.vec_id + 1)",
        f"SELECT vec_id, round(least({_RMSE.format(b='b[i]')}, {_RMSE.format(b='b[65 - i]')}), 6) AS rmse FROM next_to",
    ),
    "patch_canonical": _with(
        PATCH,
        "SELECT vec_id, array_to_string(CASE WHEN list_sum(list_filter(p, lambda v, i: (i - 1) % 8 < 4)) < list_sum(list_filter(p, lambda v, i: (i - 1) % 8 >= 4)) THEN list_reverse(p) ELSE p END, ',') AS patch FROM patch",
    ),
    "patch_median": _with(
        PIXELS + ",\nmed AS (SELECT label, y * 8 + x AS pos, CAST(floor(median(v)) AS INTEGER) AS v FROM px GROUP BY ALL)",
        "SELECT label AS track_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS patch FROM med GROUP BY label",
    ),
    "running_median": _with(_REF, f"SELECT recording_id, track_id, frame_idx, {_R('median_area_px', 'median_axis_ratio')} FROM good"),
    "continuity_scores": _with(
        _REF, "SELECT recording_id, track_id, frame_idx, round(abs(area_px - median_area_px) / median_area_px, 6) AS area_score, round(abs(axis_ratio - median_axis_ratio) / median_axis_ratio, 6) AS axis_ratio_score FROM good"
    ),
    "confident_frames": _with(
        PAIRS,
        "SELECT recording_id, frame_idx, count(*) = 4 AND bool_and(area_px BETWEEN 75 AND 225) AND coalesce(any_value(p.d) > 10, true) AS is_confident FROM det LEFT JOIN (SELECT recording_id, frame_idx, min(d) AS d FROM pair GROUP BY recording_id, frame_idx) p USING (recording_id, frame_idx) GROUP BY recording_id, frame_idx",
    ),
    "animals": _with(
        DET + """,
per AS (SELECT recording_id, count(*) AS n FROM det GROUP BY recording_id, frame_idx), freq AS (SELECT recording_id, n, count(*) AS c FROM per GROUP BY recording_id, n),
most AS (SELECT recording_id, n FROM freq QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY c DESC, n) = 1)""",
        "SELECT recording_id, any_value(n) AS n_animals, median(area_px) AS expected_area_px FROM det JOIN most USING (recording_id) GROUP BY recording_id",
    ),
    "learned_area": _with(
        DET + ", first AS (SELECT DISTINCT recording_id, frame_idx FROM det), ranked AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY frame_idx) AS r FROM first)",
        "SELECT recording_id, median(area_px) AS expected_area_px FROM det JOIN ranked USING (recording_id, frame_idx) WHERE r <= 50 GROUP BY recording_id",
    ),
    "bg_projection": _with(PIXELS, "SELECT label, y, x, v_max, v_min FROM proj"),
    "threshold_foreground": _with(PIXELS, "SELECT frame_idx, count(*) AS n_px FROM fg GROUP BY frame_idx"),
    "threshold_morph": _with(PIXELS, "SELECT * FROM " + _erode(_dilate(_dilate(_erode("fg"))))),
    "mask_algebra": _with(
        DET,
        f"SELECT recording_id, track_id, frame_idx, ({_IN_DISC} AND NOT {_IN_HOLE}) OR {_IN_TRIANGLE} AS inside, concat_ws(',', CASE WHEN {_IN_DISC} THEN 'disc' END, CASE WHEN {_IN_TRIANGLE} THEN 'corner' END) AS labels FROM det",
    ),
    "row_runs": _with(PIXELS + ", isle AS (SELECT *, x - row_number() OVER (PARTITION BY frame_idx, y ORDER BY x) AS g FROM fg)", "SELECT frame_idx, y, min(x) AS x0, max(x) AS x1 FROM isle GROUP BY frame_idx, y, g"),
    "swap_replay": _with(
        "RECURSIVE " + BLOCKS + """,
sw AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY frame_end) AS k FROM blocks WHERE frame_start % 3 = 0),
fold AS (
  SELECT recording_id, t AS track_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS f, CAST(t AS INTEGER) AS label FROM (SELECT DISTINCT recording_id, track_id AS t FROM det)
  UNION ALL
  SELECT fold.recording_id, fold.track_id, sw.k, sw.frame_end, CASE WHEN label = sw.animal_a THEN sw.animal_b WHEN label = sw.animal_b THEN sw.animal_a ELSE label END
  FROM fold JOIN sw ON sw.recording_id = fold.recording_id AND sw.k = fold.k + 1)""",
        "SELECT d.recording_id, d.track_id AS original_track_id, d.frame_idx, f.label AS track_id FROM det d ASOF JOIN fold f ON d.recording_id = f.recording_id AND d.track_id = f.track_id AND d.frame_idx > f.f",
    ),
}
