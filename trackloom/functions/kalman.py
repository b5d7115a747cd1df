"""A constant-velocity Kalman filter in closed form.

With equal noise in x and y and only positions observed, the axes are two filters of two states with
one covariance, so a filter is five numbers an axis pair: mean and velocity of each axis and pxx,
pxv, pvv. Expressions and plain numbers share the formulas.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Noise:
    position: float = 0.5
    velocity: float = 0.5
    measured: float = 1.0
    start_velocity: float = 10.0


def start(x, y, noise: Noise = Noise()) -> dict:
    r2, v2 = noise.measured**2, noise.start_velocity**2
    return {"x": x, "y": y, "vx": x * 0.0, "vy": y * 0.0, "pxx": x * 0.0 + r2, "pxv": x * 0.0, "pvv": x * 0.0 + v2}


def predict(s: dict, noise: Noise = Noise(), dt: float = 1.0) -> dict:
    return {
        "x": s["x"] + s["vx"] * dt,
        "y": s["y"] + s["vy"] * dt,
        "vx": s["vx"],
        "vy": s["vy"],
        "pxx": s["pxx"] + 2 * dt * s["pxv"] + dt * dt * s["pvv"] + noise.position**2,
        "pxv": s["pxv"] + dt * s["pvv"],
        "pvv": s["pvv"] + noise.velocity**2,
    }


def update(s: dict, x, y, noise: Noise = Noise()) -> dict:
    spread = s["pxx"] + noise.measured**2
    kx, kv = s["pxx"] / spread, s["pxv"] / spread
    dx, dy = x - s["x"], y - s["y"]
    return {
        "x": s["x"] + kx * dx,
        "y": s["y"] + kx * dy,
        "vx": s["vx"] + kv * dx,
        "vy": s["vy"] + kv * dy,
        "pxx": (1 - kx) * s["pxx"],
        "pxv": (1 - kx) * s["pxv"],
        "pvv": s["pvv"] - kv * s["pxv"],
    }


def mahalanobis2(s: dict, x, y, noise: Noise = Noise()):
    """Squared distance of a position from the state, in units of the innovation's spread."""
    dx, dy = x - s["x"], y - s["y"]
    return (dx * dx + dy * dy) / (s["pxx"] + noise.measured**2)


STATE = ("x", "y", "vx", "vy", "pxx", "pxv", "pvv")


def replay(rows: Column, noise: Noise = Noise()) -> Column:
    """State after an ordered array of (x, y), NULL positions being frames without one.

    The first row with a position starts the filter; NULL if there is none.
    """
    fields = lambda s: {k: s[k] for k in STATE}
    packed = lambda d: F.struct(*[d[k].cast("double").alias(k) for k in STATE])
    empty = F.lit(None).cast("struct<" + ",".join(f"{k}:double" for k in STATE) + ">")

    def step(acc: Column, row: Column) -> Column:
        ahead = predict(fields(acc), noise)
        seen = row["x"].isNotNull() & row["y"].isNotNull()
        first = F.when(seen, packed(start(row["x"], row["y"], noise)))
        later = F.when(seen, packed(update(ahead, row["x"], row["y"], noise))).otherwise(packed(ahead))
        return F.when(acc.isNull(), first).otherwise(later)

    return F.aggregate(rows, empty, step)


def score_ahead(state: Column, rows: Column, noise: Noise = Noise()) -> Column:
    """Struct (total, n): squared Mahalanobis distances of the rows' positions, predicting only."""
    names = ",".join(f"{k}:double" for k in STATE)
    zero = F.struct(state.cast(f"struct<{names}>").alias("s"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def step(acc: Column, row: Column) -> Column:
        ahead = predict({k: acc["s"][k] for k in STATE}, noise)
        seen = row["x"].isNotNull() & row["y"].isNotNull()
        d2 = mahalanobis2(ahead, row["x"], row["y"], noise)
        return F.struct(
            F.struct(*[ahead[k].alias(k) for k in STATE]).alias("s"),
            (acc["total"] + F.when(seen, d2).otherwise(0.0)).alias("total"),
            (acc["n"] + seen.cast("int")).alias("n"),
        )

    return F.aggregate(rows, zero, step, lambda acc: F.struct(acc["total"].alias("total"), acc["n"].alias("n")))
