"""What a stream learns: an animal's area from the first frames, then fixed; the median of a track's last patches."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import DEFAULTS, FRAME, KEY


def _folded(rows: DataFrame, keys: list[str], schema: str, start: Callable[[], object], fold: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]]) -> DataFrame:
    """Groups folded over batches: rows of frames that were done before are dropped, others come in order of frames."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = pickle.loads(state.get[0]) if state.exists else (start(), None)
        pdf = pd.concat(list(parts), ignore_index=True)
        pdf = pdf if last is None else pdf[pdf[FRAME] > last]
        if len(pdf):
            held, out = fold(held, pdf.sort_values(FRAME))
            state.update((pickle.dumps((held, int(pdf[FRAME].max()))),))
            yield out

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def learned_area_stream(detections: DataFrame, frames: int = DEFAULTS["background_frames"]) -> DataFrame:
    """The median area of a region's first frames, given once: with the frame at which it is fixed. Needs rows for the frames
    without detections, too, with a null area; while none has an area, learning goes on."""
    keys = KEY[:2]

    def fold(held: tuple, pdf: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        areas, seen, fixed = held
        out = []
        for frame, rows in pdf.groupby(FRAME, sort=True):
            if fixed:
                break
            areas, seen = areas + rows["area_px"].dropna().tolist(), seen + 1
            if seen >= frames and areas:
                fixed = True
                out.append({**{k: rows[k].iloc[0] for k in keys}, FRAME: frame, "expected_area_px": float(np.median(areas))})
        return ([] if fixed else areas, seen, fixed), pd.DataFrame(out, columns=[*keys, FRAME, "expected_area_px"])

    kinds = ", ".join(f"{k} {dict(detections.dtypes)[k]}" for k in keys)
    return _folded(detections.select(*keys, FRAME, "area_px"), keys, f"{kinds}, {FRAME} bigint, expected_area_px double", lambda: ([], 0, False), fold)


def running_patch_stream(patches: DataFrame, history: int = DEFAULTS["history"]) -> DataFrame:
    """Median of each pixel over a track's last confident patches, at each such row. The state holds those patches as bytes."""

    def fold(held: list, pdf: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        medians = []
        for patch in pdf["patch"]:
            held = [*held, np.asarray(patch, np.uint8)][-history:]
            medians.append(np.median(held, axis=0).tolist())
        return held, pdf[[*KEY, FRAME]].assign(median_patch=medians)

    kinds = ", ".join(f"{k} {dict(patches.dtypes)[k]}" for k in KEY)
    rows = patches.filter(F.col("is_confident")).select(*KEY, FRAME, "patch")
    return _folded(rows, KEY, f"{kinds}, {FRAME} bigint, median_patch array<double>", list, fold)
