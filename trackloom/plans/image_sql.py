"""SQL for the image queries: outlines traced side by side of pixels, measured by sums over their sides."""

from __future__ import annotations

from .oracle import PIXELS, _dilate, _erode, _with


def traced(fg: str, prefix: str = "") -> str:
    """CTEs that trace the outer outlines of ``fg`` (frame_idx, y, x; 0 to 7): pts (frame_idx, blob, r, x, y). Needs RECURSIVE.

    Ground that the frame's edge doesn't reach is filled; the walk goes round with the ground on its left and is read backwards.
    """
    p = prefix
    return f"""
{p}g AS (SELECT DISTINCT frame_idx, y, x FROM {fg}),
{p}place AS (SELECT frame_idx, CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS x FROM (SELECT DISTINCT frame_idx FROM {p}g), range(-1, 9) a(i), range(-1, 9) b(i)),
{p}open AS (SELECT * FROM {p}place ANTI JOIN {p}g USING (frame_idx, y, x)),
{p}out(frame_idx, y, x) AS (
  SELECT frame_idx, y, x FROM {p}open WHERE y = -1 AND x = -1
  UNION SELECT o.frame_idx, o.y, o.x FROM {p}out f JOIN {p}open o ON o.frame_idx = f.frame_idx AND abs(o.y - f.y) + abs(o.x - f.x) = 1),
{p}ins AS (SELECT * FROM {p}place ANTI JOIN {p}out USING (frame_idx, y, x)),
{p}reach(frame_idx, y, x, l) AS (
  SELECT frame_idx, y, x, y * 8 + x FROM {p}ins
  UNION SELECT a.frame_idx, a.y, a.x, r.l FROM {p}reach r JOIN {p}ins a ON a.frame_idx = r.frame_idx AND abs(a.y - r.y) <= 1 AND abs(a.x - r.x) <= 1),
{p}lab AS (SELECT frame_idx, y, x, min(l) AS l FROM {p}reach GROUP BY ALL),
{p}moves(side, ay, ax, aside, cy, cx, cside) AS (VALUES (0, -1, 1, 3, 0, 1, 0), (1, 1, 1, 0, 1, 0, 1), (2, 1, -1, 1, 0, -1, 2), (3, -1, -1, 2, -1, 0, 3)),
{p}walk(frame_idx, l, step, y, x, side) AS (
  SELECT DISTINCT frame_idx, l, 0, l // 8, l % 8, 0 FROM {p}lab
  UNION ALL
  SELECT w.frame_idx, w.l, w.step + 1, coalesce(a.y, c.y, w.y), coalesce(a.x, c.x, w.x), CASE WHEN a.y IS NOT NULL THEN m.aside WHEN c.y IS NOT NULL THEN m.cside ELSE (w.side + 1) % 4 END
  FROM {p}walk w JOIN {p}moves m ON m.side = w.side
  LEFT JOIN {p}ins a ON a.frame_idx = w.frame_idx AND a.y = w.y + m.ay AND a.x = w.x + m.ax
  LEFT JOIN {p}ins c ON c.frame_idx = w.frame_idx AND c.y = w.y + m.cy AND c.x = w.x + m.cx
  WHERE w.step = 0 OR w.y <> w.l // 8 OR w.x <> w.l % 8 OR w.side <> 0),
{p}round AS (
  SELECT *, lag(y) OVER o AS py, lag(x) OVER o AS px, count(*) OVER (PARTITION BY frame_idx, l) AS n FROM {p}walk
  WHERE step = 0 OR y <> l // 8 OR x <> l % 8 OR side <> 0 WINDOW o AS (PARTITION BY frame_idx, l ORDER BY step)),
{p}pts AS (
  SELECT frame_idx, dense_rank() OVER (PARTITION BY frame_idx ORDER BY l) - 1 AS blob, row_number() OVER (PARTITION BY frame_idx, l ORDER BY step DESC) - 1 AS r, x, y
  FROM {p}round WHERE y <> py OR x <> px OR n = 4 AND step = 0)"""


def sized(pts: str, keys: str, name: str) -> str:
    """CTEs that measure the closed outlines of ``pts`` (keys, r, x, y) as ``name``; the hull by rows, each the least of all chords."""
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_side AS (
  SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER (PARTITION BY {keys} ORDER BY r)) AS u, coalesce(lead(y) OVER w, first_value(y) OVER (PARTITION BY {keys} ORDER BY r)) AS v
  FROM {pts} WINDOW w AS (PARTITION BY {keys} ORDER BY r)),
{name}_cross AS (SELECT *, CAST(x * v - u * y AS DOUBLE) AS c FROM {name}_side),
{name}_sum AS (
  SELECT {keys}, count(*) AS n_points, sum(sqrt((u - x) ** 2 + (v - y) ** 2)) AS perimeter_px, avg(x) AS mx, avg(y) AS my, nullif(sum(c) / 2, 0) AS m00, sum(c * (x + u)) / 6 AS m10, sum(c * (y + v)) / 6 AS m01,
         sum(c * (x * x + x * u + u * u)) / 12 AS m20, sum(c * (y * y + y * v + v * v)) / 12 AS m02, sum(c * (2 * x * y + x * v + u * y + 2 * u * v)) / 24 AS m11
  FROM {name}_cross GROUP BY {keys}),
{name}_ends AS (SELECT {keys}, y, CAST(min(x) AS DOUBLE) AS lo, CAST(max(x) AS DOUBLE) AS hi FROM {pts} GROUP BY {keys}, y),
{name}_row AS (
  SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, t.y, min(a.lo + CASE WHEN b.y > a.y THEN (b.lo - a.lo) * (t.y - a.y) / (b.y - a.y) ELSE 0 END) AS lo,
         max(a.hi + CASE WHEN b.y > a.y THEN (b.hi - a.hi) * (t.y - a.y) / (b.y - a.y) ELSE 0 END) AS hi
  FROM {name}_ends a JOIN {name}_ends b ON {same} AND a.y <= b.y, range(8) t(y) WHERE t.y BETWEEN a.y AND b.y GROUP BY ALL),
{name}_hull AS (
  SELECT {keys}, coalesce(sum((hi - lo + nhi - nlo) / 2), 0) AS hull FROM (SELECT *, lead(hi) OVER w AS nhi, lead(lo) OVER w AS nlo FROM {name}_row WINDOW w AS (PARTITION BY {keys} ORDER BY y)) GROUP BY {keys}),
{name}_mid AS (
  SELECT *, coalesce(m10 / m00, mx) AS cx_px, coalesce(m01 / m00, my) AS cy_px, coalesce(abs(m00), 0) AS area_px FROM {name}_sum JOIN {name}_hull USING ({keys})),
{name}_var AS (
  SELECT *, CASE WHEN hull > 0 THEN area_px / hull ELSE 1 END AS solidity, coalesce(m20 / m00 - cx_px ** 2, 0) AS xx, coalesce(m02 / m00 - cy_px ** 2, 0) AS yy, coalesce(m11 / m00 - cx_px * cy_px, 0) AS xy FROM {name}_mid),
{name} AS (
  SELECT *, 4 * sqrt((xx + yy + sqrt((xx - yy) ** 2 + 4 * xy ** 2)) / 2) AS major_axis_px, 4 * sqrt(greatest((xx + yy - sqrt((xx - yy) ** 2 + 4 * xy ** 2)) / 2, 0)) AS minor_axis_px,
         radians((round(degrees(atan2(2 * xy, xx - yy)) / 2, 9) + 180) % 180) AS turn FROM {name}_var)"""


def split(pts: str, of: str, expected: float) -> str:
    """CTE part_pts: the points of merged outlines dealt to the two sides of the cut, those of others as they are."""
    return f"""
side_of AS (
  SELECT q.*, m.area_px > 1.5 * {expected} AND m.n_points >= 10 AS big, CASE WHEN round((q.x - m.cx_px) * cos(m.turn) + (q.y - m.cy_px) * sin(m.turn), 9) >= 0 THEN 0 ELSE 1 END AS half
  FROM {pts} q JOIN {of} m USING (frame_idx, blob)),
halves AS (SELECT frame_idx, blob, count(*) FILTER (half = 0) >= 5 AND count(*) FILTER (half = 1) >= 5 AS fine FROM side_of GROUP BY ALL),
part_pts AS (SELECT s.frame_idx, s.blob, CASE WHEN big AND fine THEN half ELSE 0 END AS part, r, x, y FROM side_of s JOIN halves USING (frame_idx, blob))"""


def _round(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_MEASURES = _round("area_px", "perimeter_px", "cx_px", "cy_px", "solidity", "major_axis_px", "minor_axis_px")
_TRACED = "RECURSIVE " + PIXELS + "," + traced("fg")
_SIZED = _TRACED + "," + sized("pts", "frame_idx, blob", "whole")
_GATED = ", gated AS (SELECT * FROM whole WHERE area_px BETWEEN 2 AND 64)"

# Area and length by squares of four pixel centres: a full one, half a one with its diagonal, or a side without area.
_CELLS = """,
cell AS (
  SELECT frame_idx, l, y - dy AS y, x - dx AS x, sum(CASE WHEN dy = dx THEN 1 ELSE 10 END) AS have FROM lab, range(2) a(dy), range(2) b(dx) GROUP BY ALL),
shape AS (
  SELECT frame_idx, l, sum(CASE WHEN have = 22 THEN 1.0 WHEN have IN (12, 21) THEN 0.5 ELSE 0 END) AS area_px,
         sum(CASE WHEN have IN (12, 21) THEN sqrt(2) WHEN have IN (2, 20) THEN 2 * sqrt(2) WHEN have = 11 THEN 1 ELSE 0 END) AS perimeter_px,
         greatest(1, sum(CASE WHEN have IN (12, 21, 11) THEN 1 WHEN have IN (2, 20) THEN 2 ELSE 0 END)) AS n_points FROM cell GROUP BY ALL)"""

_CLEAN = ", dark AS (SELECT px.frame_idx, px.y, px.x FROM px JOIN proj USING (label, y, x) WHERE v_max - v > 20), cleaned AS (SELECT * FROM " + _erode(_dilate(_erode(_dilate(_dilate(_erode("dark")))))) + "), kept AS (SELECT * FROM cleaned WHERE x BETWEEN 0 AND 6 AND y BETWEEN 0 AND 7)"

SQL: dict[str, str] = {
    "blob_features": _with(_SIZED, f"SELECT frame_idx, blob, n_points, {_MEASURES} FROM whole"),
    "blob_contours": _with(_TRACED, "SELECT frame_idx, CAST(blob AS INTEGER) AS blob, CAST(r AS INTEGER) AS place, x, y FROM pts"),
    "blob_perimeter": _with(_TRACED + _CELLS, "SELECT frame_idx, dense_rank() OVER (PARTITION BY frame_idx ORDER BY l) - 1 AS blob, CAST(n_points AS BIGINT) AS n_points, " + _round("area_px", "perimeter_px") + " FROM shape"),
    "auto_regions": _with(
        "RECURSIVE " + PIXELS + ", differ AS (SELECT label AS frame_idx, y, x FROM proj WHERE v_max - v_min > 52)," + traced("differ") + "," + sized("pts", "frame_idx, blob", "whole"),
        "SELECT frame_idx AS label, blob, 'add' AS operation, round(area_px, 6) AS area_px FROM whole WHERE area_px >= 1",
    ),
    "blob_solidity": _with(_SIZED, "SELECT frame_idx, blob, round(hull, 6) AS hull_px, round(solidity, 6) AS solidity FROM whole"),
    "solidity_gate": _with(_SIZED, "SELECT frame_idx, blob, n_points FROM whole WHERE round(solidity, 9) >= 0.6 AND n_points >= 5"),
    "chain_split": _with(
        _SIZED + _GATED + "," + split("pts", "gated", 8.0) + "," + sized("part_pts", "frame_idx, blob, part", "cut"),
        f"SELECT frame_idx, blob, part, n_points, {_MEASURES} FROM cut",
    ),
    "detect_frames": _with(
        "RECURSIVE " + PIXELS + _CLEAN + "," + traced("kept") + "," + sized("pts", "frame_idx, blob", "whole") + _GATED + "," + split("pts", "gated", 9.0) + ","
        + sized("part_pts", "frame_idx, blob, part", "cut"),
        f"SELECT frame_idx, CAST(row_number() OVER (PARTITION BY frame_idx ORDER BY round(area_px, 6) DESC, blob, part) - 1 AS INTEGER) AS det_idx, {_MEASURES} FROM cut "
        "WHERE n_points >= 5 AND solidity >= 0.55 AND (minor_axis_px <= 0 OR major_axis_px / minor_axis_px <= 3.7) AND round_even(cx_px, 0) BETWEEN 0 AND 6 AND round_even(cy_px, 0) BETWEEN 0 AND 7",
    ),
}
