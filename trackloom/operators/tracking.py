"""Multi-object tracking: Kalman predictions, optimal assignment, birth and retirement.

A tracker is sequential over the frames of one region of one recording; recordings and regions run
in parallel. The state between frames is a few numbers per track, so the same step serves batch
groups and streaming state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kalman
from ..schema import DEFAULTS, FRAME
from ..functions.assignment import assign

SCENE = ["recording_id", "roi_label"]


@dataclass
class Settings:
    max_px: float = DEFAULTS["track_max_px"]
    max_missed: int = DEFAULTS["max_missed"]
    area_weight: float = 0.0
    perimeter_weight: float = 0.0
    n_animals: int | None = None
    noise: kalman.Noise = field(default_factory=kalman.Noise)

    def __post_init__(self) -> None:
        if self.max_px <= 0 or self.max_missed < 0 or min(self.area_weight, self.perimeter_weight) < 0:
            raise ValueError("thresholds and weights can't be negative")


def step(tracks: dict[int, dict], next_id: int, rows: list[tuple], s: Settings) -> tuple[dict[int, dict], int, list[int | None]]:
    """One frame: rows are (x, y, area, perimeter); returns tracks, the next id, and each row's track (None: dropped).

    With a fixed number of animals every match is taken, none retires, and rows beyond the number are
    dropped.
    """
    fixed = s.n_animals is not None
    tracks = {i: t | kalman.predict(t, s.noise) for i, t in tracks.items()}
    ids, given = sorted(tracks), [None] * len(rows)
    if ids and rows:
        at = lambda k: np.array([tracks[i][k] for i in ids])
        x, y, area, perimeter = (np.array(c, float) for c in zip(*rows))
        cost = np.hypot(at("x")[:, None] - x, at("y")[:, None] - y)
        cost = cost + s.area_weight * np.abs(at("area")[:, None] - area) + s.perimeter_weight * np.abs(at("perimeter")[:, None] - perimeter)
        turned = cost.shape[0] > cost.shape[1]
        chosen = assign(cost.T if turned else cost)
        pairs = [(c, r) for r, c in enumerate(chosen)] if turned else list(enumerate(chosen))
        for a, b in pairs:
            if fixed or cost[a, b] <= s.max_px:
                given[b] = ids[a]
    for i in ids:
        tracks[i]["missed"] += 1
    for j, i in enumerate(given):
        if i is not None:
            x, y, area, perimeter = rows[j]
            tracks[i] |= kalman.update(tracks[i], x, y, s.noise) | {"area": area, "perimeter": perimeter, "missed": 0}
    if not fixed:
        tracks = {i: t for i, t in tracks.items() if t["missed"] <= s.max_missed}
    for j, (x, y, area, perimeter) in enumerate(rows):
        if given[j] is None and (not fixed or len(tracks) < s.n_animals):
            tracks[next_id] = kalman.start(x, y, s.noise) | {"area": area, "perimeter": perimeter, "missed": 0}
            given[j], next_id = next_id, next_id + 1
    return tracks, next_id, given


def run_frames(pdf: pd.DataFrame, tracks: dict[int, dict], next_id: int, s: Settings) -> tuple[pd.DataFrame, dict[int, dict], int]:
    """Track the rows of a group, frame by frame; rows of a frame keep the order of ``det_idx``."""
    pdf = pdf.sort_values([FRAME, "det_idx"])
    ids: list[int | None] = []
    values = list(zip(*(pdf[c].fillna(0.0) for c in ("cx_px", "cy_px", "area_px", "perimeter_px"))))
    at = 0
    for _, n in pdf.groupby(FRAME, sort=True).size().items():
        tracks, next_id, given = step(tracks, next_id, values[at : at + n], s)
        ids += given
        at += n
    out = pdf.assign(track_id=pd.array(ids, "Int32"))
    return out[out["track_id"].notna()], tracks, next_id


def track_detections(detections: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Give every detection a ``track_id``; needs SCENE, frame_idx, det_idx, position, area and perimeter."""
    s = settings or Settings()
    rows = detections.drop("track_id").filter(F.col("cx_px").isNotNull() & F.col("cy_px").isNotNull())
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", track_id int"
    return rows.groupBy(*SCENE).applyInPandas(lambda pdf: run_frames(pdf, {}, 0, s)[0], schema)
