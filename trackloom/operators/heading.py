"""Which way an animal looks: two-state heading resolution and yaw."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bearing_deg, circular_distance, transition_cost
from ..schema import DEFAULTS, FRAME, KEY
from .seq import fill_both, gradient, smooth, unwrap


def heading_costs(
    df: DataFrame, floor_mm_s: float, flip_penalty_deg: float, offset_deg: float = 0.0, keys: list[str] = KEY, order: str = FRAME
) -> DataFrame:
    """Rows with an orientation, with the terms of the two-state choice.

    ``cand0`` is the axis as a direction and its reverse the other state. ``lean`` is state 0's cost
    less state 1's: distances to the direction of travel, where the animal is fast enough. ``stay`` and
    ``turn`` are the costs of keeping and changing the state since the row before.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    cand = F.pmod(F.col("orientation_deg") + offset_deg, F.lit(360.0))
    rows = df.filter(F.col("orientation_deg").isNotNull()).withColumn("cand0", cand)
    travel, fast = bearing_deg(F.col("vy_mm_s"), F.col("vx_mm_s")), F.col("speed_mm_s") >= floor_mm_s
    lean = circular_distance(F.col("cand0"), travel) - circular_distance(F.col("cand0") + 180, travel)
    before = F.lag("cand0").over(w)
    return rows.withColumns(
        {
            "lean": F.when(fast, lean).otherwise(0.0),
            "stay": F.coalesce(transition_cost(F.col("cand0"), before, flip_penalty_deg), F.lit(0.0)),
            "turn": F.coalesce(transition_cost(F.col("cand0") + 180, before, flip_penalty_deg), F.lit(0.0)),
        }
    )


def two_state_path(lean: np.ndarray, stay: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The cheapest path of states 0 and 1; ties keep to state 0.

    Since one of ``stay`` and ``turn`` is always 0, the difference of the states' costs is enough: it
    is clamped by the larger of the two, turned over where turning is free, and grows by ``lean``.
    """
    n = len(lean)
    diff = np.empty(n)
    d = 0.0
    for i in range(n):
        if i:
            p = max(stay[i], turn[i])
            d = min(max(d, -p), p) * (1.0 if stay[i] == 0 else -1.0)
        d += lean[i]
        diff[i] = d
    path = np.zeros(n, int)
    state = 0 if n == 0 or diff[-1] <= 0 else 1
    for i in range(n - 1, -1, -1):
        path[i] = state
        if i:
            zero, one = (stay[i], turn[i]) if state == 0 else (turn[i], stay[i])
            state = int(diff[i - 1] + zero > one)
    return path


def resolve_headings(
    df: DataFrame, floor_mm_s: float = DEFAULTS["heading_floor_mm_s"], flip_penalty_deg: float = DEFAULTS["flip_penalty_deg"], keys: list[str] = KEY
) -> DataFrame:
    """Add ``heading_deg`` and ``heading_unresolved``.

    The recursion over a track's rows is one pass each way over four numbers a row; all else is
    windows. Rows without an orientation take the last heading before, or the first one.
    ``heading_unresolved`` marks tracks on which no row was fast enough to tell front from back.
    """
    terms = heading_costs(df, floor_mm_s, flip_penalty_deg, keys=keys).select(*keys, FRAME, "cand0", "lean", "stay", "turn")
    kinds = ", ".join(f"{c} {t}" for c, t in terms.dtypes if c in (*keys, FRAME))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(FRAME)
        path = two_state_path(rows["lean"].to_numpy(), rows["stay"].to_numpy(), rows["turn"].to_numpy())
        heading = (rows["cand0"] + 180 * path) % 360
        return rows[[*keys, FRAME]].assign(_heading=heading, _lost=not (rows["lean"] != 0).any())

    found = terms.groupBy(*keys).applyInPandas(run, f"{kinds}, _heading double, _lost boolean")
    out = df.join(found, [*keys, FRAME], "left")
    out = out.withColumn("heading_deg", fill_both("_heading", keys))
    lost = F.coalesce(F.max("_lost").over(Window.partitionBy(*keys)), F.lit(True))
    return out.withColumn("heading_unresolved", lost).drop("_heading", "_lost")


def add_yaw(df: DataFrame, fps: float, window: int = DEFAULTS["yaw_window"], degree: int = DEFAULTS["yaw_order"], keys: list[str] = KEY) -> DataFrame:
    """Add ``yaw_deg`` (headings smoothed as unit vectors, without jumps of whole turns) and ``yaw_rate_deg_s``."""
    angle = F.radians("heading_deg")
    df = df.withColumns({"_cos": F.cos(angle), "_sin": F.sin(angle)})
    df = smooth(df, {"_cos": "_c", "_sin": "_s"}, window, degree, keys)
    df = df.withColumn("_turned", F.atan2("_s", "_c"))
    df = unwrap(df, "_turned", "_yaw", keys).withColumn("yaw_deg", F.degrees("_yaw"))
    df = gradient(df, {"yaw_deg": "yaw_rate_deg_s"}, fps, keys)
    return df.drop("_cos", "_sin", "_c", "_s", "_turned", "_yaw")


