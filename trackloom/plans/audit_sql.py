"""SQL for the identity audit: filters by recursion over places, all permutations listed, decisions by recursion over blocks."""

from __future__ import annotations

from .oracle import BLOCKS, EVENTS, _blocks, _with

_AUDIT = EVENTS.format(contact=20) + ",\n" + _blocks("(contact OR missing)", 3)

# A filter's covariance is the same for both axes. Places i = 1 to 3 stand before the block; then it predicts only: through the block
# and once more for each place that lacked a position right before it, and three places after.
_EDGES = """,
ids AS (SELECT recording_id, track_id, row_number() OVER (PARTITION BY recording_id ORDER BY track_id) - 1 AS col FROM (SELECT DISTINCT recording_id, track_id FROM det)),
scene AS (SELECT recording_id, count(*) AS n FROM ids GROUP BY recording_id),
pos AS (SELECT r.recording_id, r.rank, i.col, d.cx_px AS x, d.cy_px AS y FROM ranks r JOIN ids i USING (recording_id) LEFT JOIN det d ON d.recording_id = r.recording_id AND d.frame_idx = r.frame_idx AND d.track_id = i.track_id),
pre AS (
  SELECT b.recording_id, b.block, b.rank_start, b.rank_end, a.col, count(a.x) AS known, max(a.rank) FILTER (a.x IS NOT NULL) AS last_rank, arg_max(a.x, a.rank) FILTER (a.x IS NOT NULL) AS lx, arg_max(a.y, a.rank) FILTER (a.x IS NOT NULL) AS ly
  FROM blocks b JOIN pos a ON a.recording_id = b.recording_id AND a.rank BETWEEN b.rank_start - 3 AND b.rank_start - 1 GROUP BY ALL),
walk AS (
  SELECT recording_id, block, rank_start, rank_end, col, 3 + rank_end - last_rank AS reach, 0 AS i, NULL::DOUBLE AS x, NULL::DOUBLE AS y, NULL::DOUBLE AS vx, NULL::DOUBLE AS vy, NULL::DOUBLE AS pxx, NULL::DOUBLE AS pxv, NULL::DOUBLE AS pvv
  FROM pre WHERE known >= 2
  UNION ALL
  SELECT recording_id, block, rank_start, rank_end, col, reach, i,
         CASE WHEN first THEN zx WHEN seen THEN qx + qxx / (qxx + 1) * (zx - qx) ELSE qx END, CASE WHEN first THEN zy WHEN seen THEN qy + qxx / (qxx + 1) * (zy - qy) ELSE qy END,
         CASE WHEN first THEN 0 WHEN seen THEN vx + qxv / (qxx + 1) * (zx - qx) ELSE vx END, CASE WHEN first THEN 0 WHEN seen THEN vy + qxv / (qxx + 1) * (zy - qy) ELSE vy END,
         CASE WHEN first THEN 1 WHEN seen THEN (1 - qxx / (qxx + 1)) * qxx ELSE qxx END, CASE WHEN first THEN 0 WHEN seen THEN (1 - qxx / (qxx + 1)) * qxv ELSE qxv END,
         CASE WHEN first THEN 100 WHEN seen THEN qvv - qxv / (qxx + 1) * qxv ELSE qvv END
  FROM (
    SELECT w.recording_id, w.block, w.rank_start, w.rank_end, w.col, w.reach, w.i + 1 AS i, a.x AS zx, a.y AS zy, a.x IS NOT NULL AND w.x IS NULL AS first, a.x IS NOT NULL AND w.x IS NOT NULL AS seen,
           w.x + w.vx AS qx, w.y + w.vy AS qy, w.vx, w.vy, w.pxx + 2 * w.pxv + w.pvv + 0.25 AS qxx, w.pxv + w.pvv AS qxv, w.pvv + 0.25 AS qvv
    FROM walk w LEFT JOIN pos a ON w.i < 3 AND a.recording_id = w.recording_id AND a.col = w.col AND a.rank = w.rank_start - 3 + w.i WHERE w.i < w.reach + 3)),
scored AS (
  SELECT w.recording_id, w.block, w.col, t.col AS target, avg(((t.x - w.x) ** 2 + (t.y - w.y) ** 2) / (w.pxx + 1)) AS cost
  FROM walk w JOIN pos t ON t.recording_id = w.recording_id AND t.rank = w.rank_end + w.i - w.reach WHERE w.i > w.reach AND t.x IS NOT NULL GROUP BY ALL),
post AS (
  SELECT b.recording_id, b.block, a.col AS target, arg_min(a.x, a.rank) AS fx, arg_min(a.y, a.rank) AS fy
  FROM blocks b JOIN pos a ON a.recording_id = b.recording_id AND a.rank BETWEEN b.rank_end + 1 AND b.rank_end + 3 WHERE a.x IS NOT NULL GROUP BY ALL),
edge AS (
  SELECT b.recording_id, b.block, c.col, t.col AS target, s.cost, sqrt((p.lx - q.fx) ** 2 + (p.ly - q.fy) ** 2) AS jump
  FROM blocks b JOIN ids c USING (recording_id) JOIN ids t USING (recording_id) LEFT JOIN pre p ON p.recording_id = b.recording_id AND p.block = b.block AND p.col = c.col
  LEFT JOIN post q ON q.recording_id = b.recording_id AND q.block = b.block AND q.target = t.col
  LEFT JOIN scored s ON s.recording_id = b.recording_id AND s.block = b.block AND s.col = c.col AND s.target = t.col),
grown AS (
  SELECT n, [0][1:0] AS p FROM (SELECT DISTINCT n FROM scene)
  UNION ALL SELECT n, list_append(p, CAST(t AS INTEGER)) FROM grown, range(8) x(t) WHERE len(p) < n AND t < n AND NOT list_contains(p, t)),
perms AS (SELECT n, p, row_number() OVER (PARTITION BY n ORDER BY p) - 1 AS perm_no FROM grown WHERE len(p) = n)"""

_SIDES = """ JOIN (SELECT recording_id, block FROM blocks b WHERE EXISTS (SELECT 1 FROM ranks r WHERE r.recording_id = b.recording_id AND r.rank IN (b.rank_start - 1, b.rank_end + 1))) sides USING (recording_id, block)"""

# Terms of the looks: medians of confident frames before and of all after, a grey level for a patch.
_LOOKS = """,
seen AS (
  SELECT i.recording_id, i.col, r.rank, d.frame_idx % 10 > 1 AS sure, (d.track_id * 40 + d.frame_idx % 7) % 256 AS grey, d.area_px, d.major_axis_px / d.minor_axis_px AS ratio
  FROM det d JOIN ids i USING (recording_id, track_id) JOIN ranks r USING (recording_id, frame_idx) WHERE d.frame_idx % 10 > 0),
look AS (
  SELECT b.recording_id, b.block, s.col, s.rank < b.rank_start AS pre, floor(median(grey)) AS grey, median(area_px) AS area, median(ratio) AS ratio
  FROM blocks b JOIN seen s ON s.recording_id = b.recording_id AND (s.rank BETWEEN b.rank_start - 3 AND b.rank_start - 1 AND s.sure OR s.rank BETWEEN b.rank_end + 1 AND b.rank_end + 3) GROUP BY ALL),
term AS (
  SELECT p.recording_id, p.block, p.col, q.col AS target, abs(q.grey - p.grey) AS look, abs(q.ratio - p.ratio) / greatest(p.ratio, 1e-9) AS axis, CASE WHEN p.area > 0 THEN abs(q.area - p.area) / p.area ELSE 0 END AS area
  FROM look p JOIN look q USING (recording_id, block) WHERE p.pre AND NOT q.pre)"""
_NO_LOOKS = ",\nterm AS (SELECT recording_id, block, col, target, NULL::DOUBLE AS look, NULL::DOUBLE AS axis, NULL::DOUBLE AS area FROM edge)"

# Costs of every permutation of a block; the best of them by cost, then by number; what the fold needs of a block.
_CHOICE = """,
priced AS (
  SELECT e.recording_id, e.block, p.n, p.perm_no, p.p, avg(e.cost) AS kalman, coalesce(avg(t.look), 0) AS look, coalesce(avg(t.axis), 0) AS axis, coalesce(avg(t.area), 0) AS area,
         CASE WHEN count(e.jump) = count(*) THEN max(e.jump) END AS jump
  FROM edge e JOIN scene USING (recording_id) JOIN perms p ON p.n = scene.n AND p.p[e.col + 1] = e.target LEFT JOIN term t ON t.recording_id = e.recording_id AND t.block = e.block AND t.col = e.col AND t.target = e.target
  GROUP BY ALL),
total AS (SELECT *, kalman + 0.5 * look + 2 * axis + area AS cost FROM priced),
fine AS (
  SELECT i.*, o.p AS best, o.cost AS after, o.kalman AS kalman_after, o.look AS look_after, o.axis AS axis_after, o.area AS area_after
  FROM total i JOIN blocks b USING (recording_id, block) JOIN (SELECT recording_id, max(rank) AS last FROM ranks GROUP BY recording_id) l USING (recording_id)
  JOIN (SELECT * FROM total WHERE perm_no > 0 AND jump <= 200 AND cost IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recording_id, block ORDER BY cost, perm_no) = 1) o USING (recording_id, block)
  WHERE i.perm_no = 0 AND i.kalman > 0 AND b.rank_start >= 3 AND l.last - b.rank_end >= 3 AND b.rank_end - b.rank_start < 60 AND o.cost < i.cost AND o.cost <= 0.9 * i.cost),
told AS (
  SELECT b.recording_id, b.block, b.frame_end, b.frame_start, b.animal_a, b.animal_b, b.event_id, f.best, a.col AS col_a, c.col AS col_b, {verdict} AS verdict, row_number() OVER (PARTITION BY b.recording_id ORDER BY b.block) AS k
  FROM blocks b LEFT JOIN fine f USING (recording_id, block) JOIN ids a ON a.recording_id = b.recording_id AND a.track_id = b.animal_a JOIN ids c ON c.recording_id = b.recording_id AND c.track_id = b.animal_b),
fold(recording_id, k, sigma, now, p, f) AS (
  SELECT recording_id, 0::BIGINT, [CAST(i AS INTEGER) for i in range(n)], [CAST(i AS INTEGER) for i in range(n)], NULL::INTEGER[], -1::BIGINT FROM scene
  UNION ALL
  SELECT recording_id, k, CASE WHEN p IS NULL THEN sigma ELSE list_transform(p, lambda t: sigma[t + 1]) END, CASE WHEN p IS NULL THEN now ELSE list_transform(now, lambda t: p[t + 1]) END, p, frame_end FROM (
    SELECT f.recording_id, t.k, f.sigma, f.now, t.frame_end,
           CASE WHEN t.verdict = 'accept_swap' THEN list_transform([CAST(i AS INTEGER) for i in range(len(f.sigma))], lambda i: CAST(CASE WHEN i = t.col_a THEN t.col_b WHEN i = t.col_b THEN t.col_a ELSE i END AS INTEGER))
                WHEN coalesce(t.verdict, '') NOT IN ('mount', 'reject_swap') AND t.best IS NOT NULL THEN list_transform(f.sigma, lambda c: CAST(list_position(f.sigma, t.best[c + 1]) - 1 AS INTEGER)) END AS p
    FROM fold f JOIN told t ON t.recording_id = f.recording_id AND t.k = f.k + 1)),
names AS (
  SELECT f.recording_id, f.f AS since, i.track_id, o.track_id AS label FROM fold f JOIN ids i ON i.recording_id = f.recording_id JOIN ids o ON o.recording_id = f.recording_id AND o.col = f.now[i.col + 1]
  WHERE f.k = 0 OR f.p IS NOT NULL)"""


def _decided(looks: str, verdict: str) -> str:
    return "RECURSIVE " + _AUDIT + _EDGES + looks + _CHOICE.format(verdict=verdict)


_NAMED = "SELECT d.recording_id, d.track_id AS original_track_id, m.label AS track_id, d.frame_idx, {more} FROM det d ASOF JOIN names m ON d.recording_id = m.recording_id AND d.track_id = m.track_id AND d.frame_idx > m.since"
_TERM = {"": "cost", "kalman_": "kalman", "appearance_": "look", "axis_": "axis", "area_": "area"}

SQL: dict[str, str] = {
    "perm_costs": _with(
        "RECURSIVE " + BLOCKS.replace("> 2 THEN", "> 3 THEN") + _EDGES,
        "SELECT b.recording_id, b.event_id, p.perm_no, round(avg(e.cost), 6) AS cost, round(CASE WHEN count(e.jump) = count(*) THEN max(e.jump) END, 6) AS max_jump_px "
        "FROM edge e" + _SIDES + " JOIN scene USING (recording_id) JOIN perms p ON p.n = scene.n AND p.p[e.col + 1] = e.target JOIN blocks b ON b.recording_id = e.recording_id AND b.block = e.block "
        "GROUP BY b.recording_id, b.block, b.event_id, p.perm_no",
    ),
    "audit_relabel": _with(_decided(_NO_LOOKS, "NULL::VARCHAR"), _NAMED.format(more="'' AS event_type, d.cx_px")),
    "audit_reviewed": _with(
        _decided(_NO_LOOKS, "CASE WHEN b.frame_start % 3 > 0 THEN ['accept_swap', 'reject_swap', 'mount', 'unknown'][b.frame_start % 4 + 1] END"),
        _NAMED.format(
            more="CASE WHEN EXISTS (SELECT 1 FROM told t WHERE t.recording_id = d.recording_id AND t.verdict = 'mount' AND d.frame_idx BETWEEN t.frame_start AND t.frame_end AND m.label IN (t.animal_a, t.animal_b)) THEN 'mount' ELSE '' END AS event_type"
        ),
    ),
    "audit_fingerprints": _with(
        _decided(_LOOKS, "NULL::VARCHAR"),
        "SELECT t.recording_id, t.event_id, array_to_string(f.p, ',') AS perm, "
        + ", ".join(f"round(b.{'cost' if n == 'cost' else n}, 6) AS cost_{k}before, round(b.{'after' if n == 'cost' else n + '_after'}, 6) AS cost_{k}after" for k, n in _TERM.items())
        + " FROM fold f JOIN told t ON t.recording_id = f.recording_id AND t.k = f.k JOIN fine b ON b.recording_id = t.recording_id AND b.block = t.block WHERE f.p IS NOT NULL",
    ),
}
