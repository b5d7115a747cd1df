"""Identity-risk events: frames where tracks touch, vanish or jump, in sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import event_id
from ..schema import DEFAULTS, FRAME, KEY, positive
from ..sources.scratch import keep
from .pairs import SCENE, pairwise_distance, track_grid
from .seq import frame_ranks, sessionize


def ranked_grid(df: DataFrame, x: str = "cx_smooth_px", y: str = "cy_smooth_px") -> DataFrame:
    """Every (frame, track) cell of a scene with its position, missing or not, and the frame's rank."""
    cells = df.select(*KEY, FRAME, F.col(x).alias("x"), F.col(y).alias("y"))
    grid = track_grid(df).join(cells, [*SCENE, FRAME, "track_id"], "left")
    return grid.join(frame_ranks(df), [*SCENE, FRAME])


def event_frames(grid: DataFrame, contact_px: float) -> DataFrame:
    """Per frame: least pair distance, whether any pair touches, whether any position is missing."""
    near = pairwise_distance(grid, 1.0, "x", "y").groupBy(*SCENE, FRAME).agg(F.min("distance_mm").alias("min_px"))
    frames = grid.groupBy(*SCENE, FRAME, "rank").agg(F.max(F.col("x").isNull() | F.col("y").isNull()).alias("missing"))
    out = frames.join(near, [*SCENE, FRAME], "left")
    out = out.withColumn("contact", F.coalesce(F.col("min_px") <= contact_px, F.lit(False)))
    return out.withColumn("event", F.col("contact") | F.col("missing"))


def blocks_with_pairs(frames: DataFrame, grid: DataFrame, gap: int) -> DataFrame:
    """Sessions of event frames with the pair that is closest on the mean; ties go to the least pair.

    Blocks without a pair that has a distance get the first two tracks.
    """
    inside = sessionize(frames.filter("event"), gap)
    blocks = inside.groupBy(*SCENE, "block").agg(
        F.min("rank").alias("rank_start"), F.max("rank").alias("rank_end"), F.min(FRAME).alias("frame_start"),
        F.max(FRAME).alias("frame_end"), F.count("*").alias("n_event_frames"),
    )
    spans = grid.select(*SCENE, FRAME, "rank").distinct()
    member = _inside(spans, blocks)
    pairs = pairwise_distance(grid, 1.0, "x", "y").join(member, [*SCENE, FRAME])
    mean = pairs.groupBy(*SCENE, "block", "track_i", "track_j").agg(F.avg("distance_mm").alias("mean_px"), F.min("distance_mm").alias("min_px"))
    best = mean.groupBy(*SCENE, "block").agg(F.min(F.struct("mean_px", "track_i", "track_j", "min_px")).alias("b"))
    first = grid.select(*KEY).distinct().groupBy(*SCENE).agg(F.slice(F.array_sort(F.collect_set("track_id")), 1, 2).alias("two"))
    out = blocks.join(best, [*SCENE, "block"], "left").join(first, SCENE)
    a, b = F.coalesce("b.track_i", F.col("two")[0]), F.coalesce("b.track_j", F.col("two")[1])
    return out.select(
        *SCENE, "block", "rank_start", "rank_end", "frame_start", "frame_end", a.alias("animal_a"), b.alias("animal_b"),
        F.col("b.min_px").alias("min_distance_px"), event_id(F.col("frame_start"), a, b).alias("event_id"),
    )


def _inside(frames: DataFrame, blocks: DataFrame) -> DataFrame:
    """The frames of each block, by carrying the last block start forward: no range join."""
    w = Window.partitionBy(*SCENE).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = blocks.select(*SCENE, F.col("rank_start").alias("rank"), F.struct("block", "rank_end").alias("_b"))
    carried = frames.join(starts, [*SCENE, "rank"], "left").withColumn("_b", F.last("_b", ignorenulls=True).over(w))
    return carried.filter(F.col("rank") <= F.col("_b.rank_end")).select(*SCENE, FRAME, F.col("rank"), F.col("_b.block").alias("block"))


def event_blocks(df: DataFrame, fps: float, px_per_mm: float, contact_mm: float = DEFAULTS["contact_mm"], window_s: float = DEFAULTS["audit_window_s"], coalesce: int | None = None) -> DataFrame:
    """Blocks of contact or missing positions. Gaps count places among the frames, not frame numbers."""
    positive(fps=fps, px_per_mm=px_per_mm, contact_mm=contact_mm, window_s=window_s)
    window = max(3, round(window_s * fps))
    grid = keep(ranked_grid(df), "grid")
    return blocks_with_pairs(event_frames(grid, contact_mm * px_per_mm), grid, window if coalesce is None else coalesce)


def steps(grid: DataFrame) -> DataFrame:
    """Add ``step``: pixels since the frame before, 0 at the first, NULL next to a missing position."""
    w = Window.partitionBy(*KEY).orderBy(FRAME)
    gone = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    first = F.when(F.row_number().over(w) == 1, F.when(F.col("x").isNotNull(), F.lit(0.0)))
    return grid.withColumn("step", F.when(F.row_number().over(w) == 1, first).otherwise(gone))


def detect_candidates(df: DataFrame, fps: float, px_per_mm: float, contact_mm: float = DEFAULTS["contact_mm"], jump_mm: float = DEFAULTS["candidate_jump_mm"], gap: int | None = None) -> DataFrame:
    """Blocks of contact, jump or missing positions with what raised them.

    ``source`` names contact and jump; a block of missing positions alone is called contact. The
    grid, frames and blocks are read several times and so are kept as tables.
    """
    positive(fps=fps, px_per_mm=px_per_mm, contact_mm=contact_mm, jump_mm=jump_mm)
    grid = keep(steps(ranked_grid(df)), "grid")
    jumps = grid.groupBy(*SCENE, FRAME).agg(F.max(F.coalesce(F.col("step") > jump_mm * px_per_mm, F.lit(False))).alias("jump"))
    frames = event_frames(grid, contact_mm * px_per_mm).join(jumps, [*SCENE, FRAME])
    frames = keep(frames.withColumn("event", F.col("event") | F.col("jump")), "frames")
    blocks = keep(blocks_with_pairs(frames, grid, max(3, round(fps)) if gap is None else gap), "blocks")
    spans = _inside(frames.select(*SCENE, FRAME, "rank"), blocks)
    flags = spans.join(frames.drop("rank"), [*SCENE, FRAME]).groupBy(*SCENE, "block").agg(
        F.max("contact").alias("_contact"), F.max("jump").alias("_jump"), F.count("*").cast("int").alias("n_frames")
    )
    pair_steps = (
        grid.join(spans.drop("rank"), [*SCENE, FRAME])
        .join(blocks.select(*SCENE, "block", "animal_a", "animal_b"), [*SCENE, "block"])
        .filter("track_id = animal_a or track_id = animal_b")
        .groupBy(*SCENE, "block").agg(F.max("step").alias("max_jump_px"))
    )
    out = blocks.join(flags, [*SCENE, "block"]).join(pair_steps, [*SCENE, "block"], "left")
    named = F.concat_ws(",", F.when(F.col("_contact"), "contact"), F.when(F.col("_jump"), "jump"))
    source = F.when(named == "", "contact").otherwise(named)
    return out.select(*SCENE, "event_id", "frame_start", "frame_end", "animal_a", "animal_b", source.alias("source"), "min_distance_px", "max_jump_px", "n_frames")


def segments(df: DataFrame, max_gap: int, max_jump: float, x: str = "cx_px", y: str = "cy_px") -> DataFrame:
    """Number the pieces of a trace that neither skips more than ``max_gap`` frames nor jumps further than ``max_jump``."""
    w = Window.partitionBy(*KEY).orderBy(FRAME)
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cut = ((F.col(FRAME) - F.lag(FRAME).over(w)) > max_gap) | (F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) > max_jump)
    marked = known.withColumn("_cut", F.coalesce(cut.cast("int"), F.lit(0)))
    return marked.withColumn("segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_cut")


def polylines(df: DataFrame, max_gap: int, max_jump: float) -> DataFrame:
    """Segments of two points or more, as arrays of (frame, x, y)."""
    point = F.struct(F.col(FRAME), F.col("cx_px").alias("x"), F.col("cy_px").alias("y"))
    lines = segments(df, max_gap, max_jump).groupBy(*KEY, "segment").agg(F.array_sort(F.collect_list(point)).alias("points"))
    return lines.filter(F.size("points") >= 2)


def trail(df: DataFrame, frame: int, length: int, min_alpha: float = 0.1, max_gap: int = 5) -> DataFrame:
    """Links between a trail's points that end at ``frame``, with opacities that fall with age."""
    w = Window.partitionBy(*KEY).orderBy(FRAME)
    near = df.filter(F.col(FRAME).between(frame - length, frame)).withColumns(
        {"x1": F.lead("cx_px").over(w), "y1": F.lead("cy_px").over(w), "next_frame": F.lead(FRAME).over(w)}
    )
    alpha = F.greatest(F.lit(min_alpha), 1 - (frame - F.col("next_frame")) / F.lit(max(length, 1)))
    linked = near.filter(F.col("next_frame") - F.col(FRAME) <= max_gap)
    return linked.select(*KEY, FRAME, F.col("cx_px").alias("x0"), F.col("cy_px").alias("y0"), "x1", "y1", alpha.alias("alpha"))


def traces(df: DataFrame) -> DataFrame:
    """One row per track: its samples in frame order as an array."""
    point = F.struct(F.col(FRAME), F.col("cx_px").alias("x"), F.col("cy_px").alias("y"))
    return df.groupBy(*KEY).agg(F.array_sort(F.collect_list(point)).alias("samples"))
