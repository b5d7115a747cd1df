"""Scalar expressions on angles, shapes, ids, text and review states."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wong's palette for colour-blind readers (vermilion, sky blue, bluish green, orange, yellow, reddish purple, blue,
# black), saturation and value of the colours made beyond it, and the parts of a video that backgrounds are sampled from.
PALETTE = ("#d55e00", "#56b4e9", "#009e73", "#e69f00", "#f0e442", "#cc79a7", "#0072b2", "#000000")
SATURATION, VALUE = 0.7, 0.9
SAMPLED_FROM, SAMPLED_TO = 0.1, 0.9


def length(x: Column, y: Column) -> Column:
    """Of a vector. The root of the squares' sum and not ``hypot``, whose last bit parts equal lengths at thresholds."""
    return F.sqrt(x * x + y * y)


def bearing_deg(vy: Column, vx: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(vy, vx)), F.lit(360.0))


def circular_distance(a: Column, b: Column) -> Column:
    """Degrees between two directions, 0 to 180."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def transition_cost(a: Column, b: Column, flip_penalty: float) -> Column:
    """0 up to 90 degrees of turn, then rising evenly to ``flip_penalty`` at 180."""
    d = circular_distance(a, b)
    return F.when(d <= 90, F.lit(0.0)).otherwise((d - 90) / 90 * flip_penalty)


def wrapped_radians(d: Column) -> Column:
    """A difference of angles in (-pi, pi]; +pi stays for positive differences."""
    w = F.pmod(d + math.pi, F.lit(2 * math.pi)) - math.pi
    return F.when((w == -math.pi) & (d > 0), F.lit(math.pi)).otherwise(w)


def ellipse_perimeter(major: Column, minor: Column) -> Column:
    """Ramanujan's approximation from the axes' lengths; 0 without axes."""
    a, b = major / 2, minor / 2
    h = F.when(a + b > 0, F.pow((a - b) / (a + b), 2)).otherwise(F.lit(0.0))
    return math.pi * (a + b) * (1 + 3 * h / (10 + F.sqrt(4 - 3 * h)))


def ellipse_area(major: Column, minor: Column) -> Column:
    return math.pi / 4 * major * minor


def suppression_radius(area: Column) -> Column:
    return F.sqrt(area / math.pi)


def continuity_score(value: Column, reference: Column) -> Column:
    """Relative distance from the reference; 0 where either is missing or the reference isn't positive."""
    return F.coalesce(F.when(reference > 0, F.abs(value - reference) / reference), F.lit(0.0))


def axis_ratio(major: Column, minor: Column) -> Column:
    return F.when(minor > 0, major / minor)


def saturating_subtract(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def clip_byte(v: Column) -> Column:
    """Clipped to 0..255 and cut to a whole number."""
    return F.floor(F.least(F.greatest(v, F.lit(0)), F.lit(255))).cast("smallint")


def event_id(frame: Column, a: Column, b: Column) -> Column:
    return F.concat_ws("-", frame, F.least(a, b), F.greatest(a, b))


def event_pair(event: Column) -> Column:
    """Struct (a, b) of an event id's tracks, its last two of three or more parts; (0, 1) where these aren't numbers."""
    parts = F.split(event, "-")
    a, b = (F.get(parts, F.size(parts) - i).try_cast("int") for i in (2, 1))
    fine = (F.size(parts) >= 3) & a.isNotNull() & b.isNotNull()
    return F.struct(F.when(fine, a).otherwise(0).alias("a"), F.when(fine, b).otherwise(1).alias("b"))


def encode_permutation(p: Column) -> Column:
    """Comma-separated; no permutation gives an empty text."""
    return F.coalesce(F.array_join(p.cast("array<string>"), ","), F.lit(""))


def int_list(text: Column, separator: str = r"[\s,\[\]()]+") -> Column:
    """The whole numbers of a list in text; NULL for empty texts or if anything else stands there."""
    tokens = F.filter(F.split(text, separator), lambda t: t != "")
    numbers = F.transform(tokens, lambda t: t.try_cast("int"))
    return F.when((F.size(numbers) > 0) & ~F.exists(numbers, lambda n: n.isNull()), numbers)


def is_permutation(p: Column, of: Column) -> Column:
    return F.array_sort(p) == F.array_sort(of)


def clean_number(v: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(v) & (F.abs(v) < math.inf), v)


def clean_text(v: Column) -> Column:
    return F.coalesce(F.when(~v.isin("nan", "NaN", "None"), v), F.lit(""))


def source_tokens(v: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(v, F.lit("")), ","), F.trim), lambda t: t != ""))


def merge_tokens(*token_arrays: Column) -> Column:
    """All tokens in order of first appearance."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(t, empty) for t in token_arrays]))


def parse_time(spec: Column) -> Column:
    """Seconds of ``S``, ``M:S`` or ``H:M:S``; NULL for other texts."""
    parts = F.transform(F.split(spec, ":"), lambda p: F.trim(p).try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)
    return F.when((F.size(parts) <= 3) & ~F.exists(parts, lambda p: p.isNull()), total)


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def improvement_ratio(before: Column, after: Column) -> Column:
    """The part of the cost that a change saves; 0 where a cost isn't finite or there was none before."""
    fine = clean_number(before).isNotNull() & clean_number(after).isNotNull() & (before > 0)
    return F.when(fine, 1 - after / before).otherwise(F.lit(0.0))


def review_status(verdict: Column, audit_committed: Column) -> Column:
    committed = F.when(F.coalesce(audit_committed, F.lit(False)), F.lit("auto_swap"))
    return F.coalesce(F.nullif(verdict, F.lit("")), committed, F.lit("pending"))


def polarity_backgrounds(polarity: Column, most: Column, least: Column) -> Column:
    """Struct (detection, trail): dark animals on light ground are found against the brightest projection and leave their
    trail in the darkest, light ones the other way round. Another polarity is an error."""
    pair = lambda found, trail: F.struct(found.alias("detection"), trail.alias("trail"))
    unknown = F.raise_error(F.concat(F.lit("unknown polarity: "), F.coalesce(polarity, F.lit("null")))).cast("struct<detection:double,trail:double>")
    return F.when(polarity == "dark_on_light", pair(most, least)).when(polarity == "light_on_dark", pair(least, most)).otherwise(unknown)


def hex_channels(colour: Column) -> Column:
    """Struct (b, g, r) of #rrggbb."""
    part = lambda i: F.conv(F.substring(colour, i, 2), 16, 10).cast("int")
    return F.struct(part(6).alias("b"), part(4).alias("g"), part(2).alias("r"))


def track_colour(index: Column) -> Column:
    """Fixed colours first, then hues a golden angle apart, as #rrggbb."""
    fixed = F.get(F.array(*[F.lit(c) for c in PALETTE]), F.least(index, F.lit(len(PALETTE) - 1)).cast("int"))
    hue = F.pmod(index * 0.61803398875, F.lit(1.0))

    def channel(shift: int) -> Column:
        k = F.pmod(F.lit(float(shift)) + hue * 6, F.lit(6.0))
        level = VALUE - VALUE * SATURATION * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.floor(level * 255).cast("bigint"))), 2, "0")

    made = F.concat(F.lit("#"), channel(5), channel(3), channel(1))
    return F.when(index < len(PALETTE), fixed).otherwise(made)


def clamp_range(lo: Column, hi: Column, total: Column) -> Column:
    """Struct (lo, hi) of frames to show of ``total``, one apart at least; a hi of 0 stands for the last frame. NULL without frames."""
    last = total - 1
    low = F.greatest(F.lit(0), F.least(lo, last))
    high = F.greatest(low + 1, F.least(F.when(hi == 0, last).otherwise(hi), last))
    return F.when(total >= 1, F.struct(low.alias("lo"), high.alias("hi")))


def frame_fraction(frame: Column, total: Column) -> Column:
    """A frame's place in a movie, 0 to 1."""
    return F.when(total <= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), frame / (total - 1))))


def clamp_frame(frame: Column, shown: Column) -> Column:
    """The frame of a shown range that is nearest."""
    return F.greatest(shown["lo"], F.least(shown["hi"], frame))


def trim_fractions(start_s: Column, end_s: Column, duration_s: Column) -> Column:
    """Struct (start, end) of a trim as parts of the duration, a hundredth apart at least; without a trim the sampled part."""
    start = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(0.99), start_s / duration_s)), F.lit(SAMPLED_FROM))
    start = F.when(start_s.isNotNull() & (duration_s > 0), start).otherwise(F.lit(SAMPLED_FROM))
    end = F.when(end_s.isNotNull() & (duration_s > 0), F.greatest(start + 0.01, F.least(F.lit(1.0), end_s / duration_s))).otherwise(F.lit(SAMPLED_TO))
    return F.struct(start.alias("start"), end.alias("end"))


def trim_span(start_s: Column, end_s: Column, duration_s: Column) -> Column:
    """Struct (start, end) of a trim as parts of the duration, a millisecond apart at least; unset ends are the video's."""
    start = F.greatest(F.lit(0.0), F.least(duration_s - 1e-3, F.coalesce(start_s, F.lit(0.0))))
    end = F.greatest(start + 1e-3, F.least(duration_s, F.coalesce(end_s, duration_s)))
    known = duration_s > 0
    return F.struct(
        F.when(known, start / duration_s).otherwise(F.lit(SAMPLED_FROM)).alias("start"), F.when(known, end / duration_s).otherwise(F.lit(SAMPLED_TO)).alias("end")
    )


def zoom_window(frame_start: Column, frame_end: Column, frames: int) -> Column:
    """Struct (lo, hi) of frames around an event's middle; the middle and half the window are whole frames."""
    middle, half = F.floor((frame_start + frame_end) / 2), max(1, frames // 2)
    return F.struct((middle - half).alias("lo"), (middle + half).alias("hi"))


def seconds_to_frame(s: Column, fps: float) -> Column:
    return F.bround(s * fps).cast("bigint")


def raster_column(frame: Column, lo: int | Column, hi: int | Column, width: int) -> Column:
    """The pixel column of a frame in a strip over lo..hi; NULL outside."""
    lo, hi = (F.lit(v) if isinstance(v, int) else v for v in (lo, hi))
    return F.when(frame.between(lo, hi), F.floor((frame - lo) / F.greatest(hi - lo, F.lit(1)) * (width - 1)).cast("int"))


def strip_suffix(path: Column, *suffixes: str) -> Column:
    """``path`` without the first of the suffixes that it ends with."""
    out = path
    for suffix in reversed(suffixes):
        out = F.when(F.endswith(path, F.lit(suffix)), F.left(path, F.length(path) - len(suffix))).otherwise(out)
    return out
