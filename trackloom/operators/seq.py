"""Ordered-sequence operators: windows over a track's frames.

``keys`` name the sequence (a track, mostly), ``order`` its frames. All are built from window
functions, so one shuffle by the keys serves a chain of them.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import wrapped_radians
from ..schema import FRAME, KEY, odd_window, positive


def _w(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def _up_to(keys: list[str], order: str):
    return _w(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _from(keys: list[str], order: str):
    return _w(keys, order).rowsBetween(Window.currentRow, Window.unboundedFollowing)


def refuse_repeats(df: DataFrame, keys: list[str] = KEY, order: str = FRAME) -> DataFrame:
    """``df`` itself, failing at run time on two rows of one frame of a track."""
    n = F.count("*").over(Window.partitionBy(*keys, order))
    checked = df.withColumn("_n", n)
    fine = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a track has two rows for one frame")).cast("boolean"))
    return checked.filter(fine).drop("_n")


def densify(df: DataFrame, keys: list[str] = KEY, order: str = FRAME) -> DataFrame:
    """A row for each frame from a track's first to its last; ``observed`` tells which were there."""
    spans = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    grid = spans.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(order))
    return grid.join(df.withColumn("observed", F.lit(True)), [*keys, order], "left").withColumn(
        "observed", F.coalesce("observed", F.lit(False))
    )


def fill_both(column: str, keys: list[str] = KEY, order: str = FRAME) -> Column:
    """The last value before a gap, or the first one at all."""
    return F.coalesce(
        F.last(column, ignorenulls=True).over(_up_to(keys, order)), F.first(column, ignorenulls=True).over(_from(keys, order))
    )


def flag_outliers(df: DataFrame, max_speed: float, scale: float, x: str = "cx_px", y: str = "cy_px", keys: list[str] = KEY, order: str = FRAME) -> DataFrame:
    """Add ``outlier_rejected``: positions reached too fast from the last valid one.

    ``scale`` turns pixels a frame into the unit of ``max_speed``. A rejected sample is no base for
    the next, which is kept; so inside a run of fast steps every other sample goes, the first one too.
    """
    positive(max_speed=max_speed, scale=scale)
    valid = F.col(x).isNotNull() & F.col(y).isNotNull()
    same = [*keys, "_valid"]
    w = _w(same, order)
    marked = df.withColumn("_valid", valid)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) / (F.col(order) - F.lag(order).over(w))
    marked = marked.withColumns({"_fast": F.coalesce(F.col("_valid") & (step * scale > max_speed), F.lit(False)), "_j": F.row_number().over(w)})
    slow = F.max(F.when(~F.col("_fast"), F.col("_j"))).over(_up_to(same, order))
    rejected = F.col("_fast") & ((F.col("_j") - slow) % 2 == 1)
    return marked.withColumn("outlier_rejected", rejected).drop("_valid", "_fast", "_j")


def interpolate_gaps(df: DataFrame, columns: list[str], max_gap: int, keys: list[str] = KEY, order: str = FRAME) -> DataFrame:
    """Fill runs of up to ``max_gap`` missing values between two known ones on a straight line."""
    if max_gap < 0:
        raise ValueError("max_gap can't be negative")
    out = {}
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("f"), F.col(c).alias("v")))
        a, b = F.last(known, ignorenulls=True).over(_up_to(keys, order)), F.first(known, ignorenulls=True).over(_from(keys, order))
        near = (b["f"] - a["f"] - 1) <= max_gap
        out[c] = F.coalesce(F.col(c), F.when(near, a["v"] + (b["v"] - a["v"]) * (F.col(order) - a["f"]) / (b["f"] - a["f"])))
    return df.withColumns(out)


def runs(df: DataFrame, present: Column, name: str = "run", keys: list[str] = KEY, order: str = FRAME) -> DataFrame:
    """Add a number for each unbroken run of consecutive rows with or without ``present``."""
    change = (F.col("_p") != F.lag("_p").over(_w(keys, order))).cast("int")
    marked = df.withColumn("_p", present)
    return marked.withColumn(name, F.sum(F.coalesce(change, F.lit(0))).over(_up_to(keys, order))).drop("_p")


def hat_matrix(window: int, order: int) -> np.ndarray:
    """Rows give the polynomial fit's value at each place of the window."""
    odd_window(window, order)
    # By whole fractions: each weight is the double next to the exact one, as in a published table.
    places = [Fraction(i - window // 2) for i in range(window)]
    basis: list[list[Fraction]] = []
    for k in range(order + 1):
        v = [p**k for p in places]
        for b in basis:
            part = sum(x * y for x, y in zip(v, b)) / sum(y * y for y in b)
            v = [x - part * y for x, y in zip(v, b)]
        basis.append(v)
    norms = [sum(y * y for y in b) for b in basis]
    return np.array([[float(sum(b[i] * b[j] / n for b, n in zip(basis, norms))) for j in range(window)] for i in range(window)])


def smooth(df: DataFrame, columns: dict[str, str], window: int, degree: int, keys: list[str] = KEY, order: str = FRAME) -> DataFrame:
    """Savitzky-Golay over each run of known values; ``columns`` maps sources to results.

    Inside a run the window's centre is fitted; the first and last half windows come from the
    polynomial of the run's first and last full window. Runs shorter than the window stay as they are.
    """
    hat, half = hat_matrix(window, degree), window // 2
    for source, result in columns.items():
        df = runs(df, F.col(source).isNotNull(), "_run", keys, order)
        w = _w([*keys, "_run"], order)
        df = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys, "_run"))})
        near = {o: F.lead(source, o).over(w) if o > 0 else F.lag(source, -o).over(w) if o < 0 else F.col(source) for o in range(1 - window, window)}
        df = df.withColumns({f"_s{o + window}": v for o, v in near.items()})
        dot = lambda row, first: sum((float(hat[row][j]) * F.col(f"_s{j + first + window}") for j in range(1, window)), float(hat[row][0]) * F.col(f"_s{first + window}"))
        value = F.when(F.col(source).isNull() | (F.col("_n") < window), F.col(source))
        for i in range(half):
            value = value.when(F.col("_i") == i, dot(i, -i))
            value = value.when(F.col("_i") == F.col("_n") - 1 - i, dot(window - 1 - i, i - window + 1))
        value = value.otherwise(dot(half, -half))
        df = df.withColumn(result, value).drop("_run", "_i", "_n", *[f"_s{o + window}" for o in near])
    return df


def gradient(df: DataFrame, columns: dict[str, str], scale: float, keys: list[str] = KEY, order: str = FRAME) -> DataFrame:
    """Central differences a frame times ``scale`` over each run of known values, one-sided at its ends.

    A run of one value has no gradient.
    """
    for source, result in columns.items():
        df = runs(df, F.col(source).isNotNull(), "_run", keys, order)
        w = _w([*keys, "_run"], order)
        before, after = F.lag(source).over(w), F.lead(source).over(w)
        slope = F.when(before.isNull(), after - F.col(source)).when(after.isNull(), F.col(source) - before).otherwise((after - before) / 2)
        df = df.withColumn(result, slope * scale).drop("_run")
    return df


def unwrap(df: DataFrame, source: str, result: str, keys: list[str] = KEY, order: str = FRAME) -> DataFrame:
    """Radians without jumps of whole turns: the first value plus all wrapped steps."""
    w = _w(keys, order)
    step = F.coalesce(wrapped_radians(F.col(source) - F.lag(source).over(w)), F.lit(0.0))
    first = F.first(source).over(_up_to(keys, order))
    df = df.withColumns({"_step": step, "_first": first})
    return df.withColumn(result, F.col("_first") + F.sum("_step").over(_up_to(keys, order))).drop("_step", "_first")


def schmitt(df: DataFrame, source: str, on: float, off: float, result: str = "active", keys: list[str] = KEY, order: str = FRAME) -> DataFrame:
    """On above ``on``, off below ``off``, held between them and where the value is missing; off at first."""
    if not on >= off:
        raise ValueError("the upper threshold can't be below the lower one")
    signal = F.when(F.col(source) > on, F.lit(True)).when(F.col(source) < off, F.lit(False))
    df = df.withColumn("_signal", signal)
    held = F.last("_signal", ignorenulls=True).over(_up_to(keys, order))
    return df.withColumn(result, F.coalesce(held, F.lit(False))).drop("_signal")


def frame_ranks(df: DataFrame, keys: list[str] = KEY[:2], order: str = FRAME) -> DataFrame:
    """The different frames of a recording with their place (``rank``, from 0) among them."""
    frames = df.select(*keys, order).distinct()
    return frames.withColumn("rank", F.row_number().over(_w(keys, order)) - 1)


def sessionize(df: DataFrame, gap: int, order: str = "rank", name: str = "block", keys: list[str] = KEY[:2]) -> DataFrame:
    """Number the sessions of rows that follow each other within ``gap``."""
    step = F.col(order) - F.lag(order).over(_w(keys, order))
    df = df.withColumn("_new", F.coalesce((step > gap).cast("int"), F.lit(0)))
    return df.withColumn(name, F.sum("_new").over(_up_to(keys, order))).drop("_new")
