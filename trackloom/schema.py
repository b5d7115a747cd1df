"""Table schemas, keys and defaults.

A recording's rows are keyed by ``KEY``; frames order them. Missing values are NULL inside the
library: readers turn NaN into NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One track of one region of one recording.
KEY = ["recording_id", "roi_label", "track_id"]
FRAME = "frame_idx"

DETECTIONS = (
    "frame_idx bigint, roi_label string, track_id int, cx_px double, cy_px double, x_mm double, y_mm double, "
    "area_px double, perimeter_px double, solidity double, major_axis_px double, minor_axis_px double, orientation_deg double"
)
TRAJECTORY = DETECTIONS + (
    ", cx_smooth_px double, cy_smooth_px double, vx_mm_s double, vy_mm_s double, speed_mm_s double, heading_deg double, "
    "yaw_deg double, yaw_rate_deg_s double, interpolated boolean, outlier_rejected boolean, heading_unresolved boolean"
)
AUDITED = TRAJECTORY + ", original_track_id int, event_type string"
CANDIDATES = (
    "event_id string, frame_start bigint, frame_end bigint, animal_a int, animal_b int, source string, "
    "min_distance_px double, max_jump_px double, n_frames int"
)
VERDICTS = (
    "event_id string, frame_start bigint, frame_end bigint, animal_a int, animal_b int, verdict string, source string, "
    "reviewer string, timestamp_iso string, note string, permutation string"
)
SWAP_LOG = (
    "frame_idx bigint, event_id string, frame_start bigint, frame_end bigint, verdict string, permutation string, "
    "cost_before double, cost_after double, improvement_ratio double, "
    + ", ".join(f"cost_{k}_{w} double" for k in ("kalman", "appearance", "axis", "area") for w in ("before", "after"))
)
VERDICT_KINDS = ("accept_swap", "reject_swap", "mount", "unknown")

#: Decimals of the detections sink.
DETECTION_DECIMALS = {
    "cx_px": 3, "cy_px": 3, "x_mm": 4, "y_mm": 4, "area_px": 1, "perimeter_px": 2, "solidity": 4, "major_axis_px": 3,
    "minor_axis_px": 3, "orientation_deg": 2,
}

# Defaults of all stages.
DEFAULTS = {
    "gap_divisor": 12, "max_speed_mm_s": 200.0, "smooth_window": 11, "smooth_order": 3, "heading_floor_mm_s": 1.0,
    "flip_penalty_deg": 90.0, "yaw_window": 7, "yaw_order": 2, "walk_on_mm_s": 2.5, "walk_off_mm_s": 1.0, "bout_s": 0.1,
    "heat_bins": 64, "outer_fraction": 0.20, "track_max_px": 50.0, "max_missed": 5, "process_noise": 0.5,
    "measurement_noise": 1.0, "initial_velocity_sd": 10.0, "contact_mm": 5.0, "audit_window_s": 1.0, "improve_ratio": 0.7,
    "block_windows": 5, "jump_contacts": 2, "candidate_jump_mm": 5.0, "patch_h": 16, "patch_w": 32, "patch_pad": 1.5, "history": 250,
    "area_tolerance": 0.5, "separation": 1.5, "background_frames": 50,
}


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` itself, if it has the columns."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def positive(**values: float) -> None:
    """Refuse values that aren't above 0."""
    for name, value in values.items():
        if not value > 0:
            raise ValueError(f"{name} must be positive, not {value}")


def odd_window(window: int, order: int) -> None:
    """Refuse smoothing windows that are even or not above the polynomial's order."""
    if window < 3 or window % 2 == 0 or not 0 <= order < window:
        raise ValueError(f"a window of {window} rows can't fit order {order}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of any floating column becomes NULL, so comparisons and aggregates skip it."""
    floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
