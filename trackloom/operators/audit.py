"""Identity audit: per event block, the assignment of later to earlier tracks that fits motion best.

A block's cost of a permutation is a mean over tracks of terms that depend on one (track, target)
edge each. So each block yields a table of edges, and its cheapest permutation is found by ranked
assignments, both in parallel over all blocks. Swaps in earlier blocks only rename later tracks, so the
sequential part is a fold over a recording's decided blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.assignment import cheapest_other
from ..functions.kalman import Noise, replay, score_ahead
from ..functions.patches import flip_rmse
from ..functions.scalar import continuity_score, improvement_ratio
from ..schema import DEFAULTS, FRAME, positive
from ..sources.scratch import keep, spread
from .appearance import median_patch, window_features
from .events import blocks_with_pairs, event_frames, ranked_grid
from .pairs import SCENE
from .review import tag_mounts

#: Permutations of up to this many tracks are listed as a table.
MOST_LISTED = 6
#: Places that a block needs on each side to be swapped by cost.
LEAST_WINDOW = 3
#: What edges may have beside motion: distance of patches, differences of axis ratio and area.
TERMS = ("look", "axis", "area")
COSTS = [f"cost_{k}{w}" for k in ("", "kalman_", "appearance_", "axis_", "area_") for w in ("before", "after")]


def permutations(spark: SparkSession, n: int) -> DataFrame:
    """All permutations of 0..n-1 in lexicographic order, one row for each place: perm_no, place, target."""
    if not 2 <= n <= MOST_LISTED:
        raise ValueError(f"permutations of 2 to {MOST_LISTED} tracks can be listed, not {n}")
    rows = [(k, i, t) for k, p in enumerate(itertools.permutations(range(n))) for i, t in enumerate(p)]
    return spark.createDataFrame(rows, "perm_no int, place int, target int")


def _columns(grid: DataFrame) -> DataFrame:
    """The place of each track among its scene's."""
    w = Window.partitionBy(*SCENE).orderBy("track_id")
    return grid.select(*SCENE, "track_id").distinct().withColumn("col", F.row_number().over(w) - 1)


def _around(blocks: DataFrame, window: int) -> DataFrame:
    """Blocks spread over the ``window`` places before them (pre) and after them, for joins on equal keys."""
    return blocks.select(
        *SCENE, "block",
        F.explode(F.concat(
            F.transform(F.sequence(F.lit(1), F.lit(window)), lambda i: F.struct((F.col("rank_start") - i).alias("rank"), F.lit(True).alias("pre"))),
            F.transform(F.sequence(F.lit(1), F.lit(window)), lambda i: F.struct((F.col("rank_end") + i).alias("rank"), F.lit(False).alias("pre"))),
        )).alias("w"),
    ).select(*SCENE, "block", "w.rank", "w.pre")


def window_samples(grid: DataFrame, blocks: DataFrame, window: int) -> DataFrame:
    """For each block and track, the ordered samples of ``window`` places before and after the block."""
    rows = grid.join(_around(blocks, window), [*SCENE, "rank"]).join(_columns(grid), [*SCENE, "track_id"])
    sample = F.struct("rank", "x", "y")
    ordered = lambda pre: F.array_sort(F.collect_list(F.when(F.col("pre") == pre, sample)))
    return rows.groupBy(*SCENE, "block", "col", "track_id").agg(ordered(True).alias("before"), ordered(False).alias("after"))


def edge_costs(samples: DataFrame, blocks: DataFrame, noise: Noise = Noise()) -> DataFrame:
    """Per block and pair of columns (col, target): the motion cost of going on as the target, and the jump.

    A filter over the samples before the block predicts through it and is scored on the target's
    samples after it, the mean squared Mahalanobis distance. Places without a position right before the block count
    twice in the prediction, as in the samples and on the way from the last position. NULL where the track has fewer than
    two positions before, or the target none after.
    """
    seen = lambda a: F.filter(a, lambda s: s["x"].isNotNull() & s["y"].isNotNull())
    length = blocks.select(*SCENE, "block", "rank_start", "rank_end")
    pre = samples.select(*SCENE, "block", "col", F.col("before"), seen(F.col("before")).alias("known")).join(length, [*SCENE, "block"])
    blank = F.struct(F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    pre = pre.withColumn("last", F.try_element_at("known", F.lit(-1)))
    bridge = F.array_repeat(blank, F.coalesce(F.col("rank_end") - F.col("last.rank"), F.lit(0)).cast("int"))
    pre = pre.withColumn("state", F.when(F.size("known") >= 2, replay(F.concat("before", bridge), noise))).drop("before", "known")
    post = samples.select(*SCENE, "block", F.col("col").alias("target"), "after", F.get(seen(F.col("after")), F.lit(0)).alias("first"))
    edges = pre.join(post, [*SCENE, "block"])
    ahead = score_ahead(F.col("state"), F.col("after"), noise)
    edges = edges.withColumn("_s", F.when(F.col("state").isNotNull() & F.col("first").isNotNull(), ahead))
    return edges.select(
        *SCENE, "block", "col", "target",
        F.when(F.col("_s.n") > 0, F.col("_s.total") / F.col("_s.n")).alias("cost"),
        F.hypot(F.col("last.x") - F.col("first.x"), F.col("last.y") - F.col("first.y")).alias("jump_px"),
    )


def appearance_edges(fingerprints: DataFrame, grid: DataFrame, blocks: DataFrame, window: int) -> DataFrame:
    """Per block and pair of columns (col, target): how the target looks after the block against the track before it.

    ``fingerprints`` has a row per frame and track: patch, area, axes, is_confident. What stands before
    a block is the median over confident frames (any row of the frame is), what stands after it the
    median over all. ``look`` is the patches' distance, ``axis`` and ``area`` are relative differences.
    Pairs that lack a side aren't there. Only rows inside windows have their pixels exploded.
    """
    keys = [c for c in (*SCENE, "track_id", FRAME) if c in fingerprints.columns]
    frame = [c for c in keys if c != "track_id"]
    sure = fingerprints.groupBy(*frame).agg(F.max(F.coalesce("is_confident", F.lit(False))).alias("_sure"))
    cells = grid.select(*SCENE, "track_id", FRAME, "rank").join(_around(blocks, window), [*SCENE, "rank"])
    seen = fingerprints.select(*keys, "patch", "area_px", "major_axis_px", "minor_axis_px")
    rows = cells.join(seen, keys).join(sure, frame).filter(~F.col("pre") | F.col("_sure")).join(_columns(grid), [*SCENE, "track_id"])
    side = [*SCENE, "block", "col", "pre"]
    looks = median_patch(rows, side).join(window_features(rows, side), side).filter("axis_ratio is not null and area_px is not null")
    before = looks.filter("pre").select(*SCENE, "block", "col", F.col("patch").alias("_patch"), F.col("axis_ratio").alias("_axis"), F.col("area_px").alias("_area"))
    after = looks.filter("not pre").select(*SCENE, "block", F.col("col").alias("target"), "patch", "axis_ratio", "area_px")
    return before.join(after, [*SCENE, "block"]).select(
        *SCENE, "block", "col", "target",
        flip_rmse(F.col("patch"), F.col("_patch")).alias("look"),
        (F.abs(F.col("axis_ratio") - F.col("_axis")) / F.greatest(F.col("_axis"), F.lit(1e-9))).alias("axis"),
        continuity_score(F.col("area_px"), F.col("_area")).alias("area"),
    )


def permutation_costs(edges: DataFrame, perms: DataFrame) -> DataFrame:
    """Per block and permutation: mean cost over the edges that have one, and the longest jump (NULL if an end is missing)."""
    met = edges.join(F.broadcast(perms.select("perm_no", F.col("place").alias("col"), "target")), ["col", "target"])
    complete = F.count("jump_px") == F.count("*")
    return met.groupBy(*SCENE, "block", "perm_no").agg(
        F.avg("cost").alias("cost"), F.when(complete, F.max("jump_px")).alias("max_jump_px")
    )


def nth_permutation(n: Column, k: Column) -> Column:
    """The k-th permutation of 0..n-1 in lexicographic order, as an array: k's digits to factorial bases pick from what is left."""
    start = F.struct(F.sequence(F.lit(0), n - 1).alias("rest"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        picked = F.get(acc["rest"], (F.floor(k / F.factorial(n - 1 - i)) % (n - i)).cast("int"))
        return F.struct(F.array_except(acc["rest"], F.array(picked)).alias("rest"), F.array_append(acc["out"], picked).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda acc: acc["out"])


def listed_costs(edges: DataFrame) -> DataFrame:
    """As ``permutation_costs``, over all permutations of each block's own tracks: n! rows for a block of n.

    Each block makes its own permutations, so what moves is a row per block.
    """
    cells = F.array_sort(F.collect_list(F.struct("col", "target", "cost", "jump_px"))).alias("_cells")
    met = edges.groupBy(*SCENE, "block").agg(cells, (F.max("col") + 1).cast("int").alias("_n"))
    met = met.withColumn("perm_no", F.explode(F.sequence(F.lit(0).cast("long"), F.factorial("_n") - 1)))
    met = met.withColumn("_perm", nth_permutation(F.col("_n"), F.col("perm_no")))
    chosen = F.transform("_perm", lambda target, col: F.get(F.col("_cells"), col * F.col("_n") + target))
    met = met.select(*SCENE, "block", "perm_no", chosen.alias("_chosen"))
    costs = F.filter(F.transform("_chosen", lambda e: e["cost"]), lambda c: c.isNotNull())
    total = F.aggregate(costs, F.lit(0.0), lambda acc, c: acc + c)
    jumps = F.transform("_chosen", lambda e: e["jump_px"])
    return met.select(
        *SCENE, "block", "perm_no",
        F.when(F.size(costs) > 0, total / F.size(costs)).alias("cost"),
        F.when(~F.exists(jumps, lambda j: j.isNull()), F.array_max(jumps)).alias("max_jump_px"),
    )


def best_permutations(costs: DataFrame, max_jump_px: float) -> DataFrame:
    """Per block the identity's cost and the cheapest other permutation whose jumps are all short enough; ties go to the first."""
    fine = (F.col("perm_no") > 0) & (F.col("max_jump_px") <= max_jump_px) & F.col("cost").isNotNull()
    best = F.min(F.when(fine, F.struct("cost", "perm_no")))
    return costs.groupBy(*SCENE, "block").agg(F.min(F.when(F.col("perm_no") == 0, F.col("cost"))).alias("identity_cost"), best.alias("b")).select(
        *SCENE, "block", "identity_cost", F.col("b.cost").alias("best_cost"), F.col("b.perm_no").alias("perm_no")
    )


def solve_blocks(rows: DataFrame, max_jump_px: float, max_block: int, weights: tuple[float, float, float]) -> DataFrame:
    """Adds to each block its cheapest permutation of the original labels, the identity's costs and that one's, all blocks in parallel.

    Swaps before a block rename its tracks and leave the costs of their continuations as they are, so what is found here holds
    whatever was decided before. Only the choice among equal costs goes by the names: such blocks (``tied``) keep their edges.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = "n int, tied boolean, best array<int>, before array<double>, after array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in batches:
            out = [_solved(_parts(row.edges), row.length <= max_block and row.whole, max_jump_px, weights) for row in group.itertuples()]
            group = group.assign(**{name: [o[k] for o in out] for k, name in enumerate(("n", "tied", "best", "before", "after"))})
            group["edges"] = [e if o[1] else None for e, o in zip(group["edges"], out)]
            yield group

    return rows.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", " + found)


def _parts(edges: list[dict]) -> np.ndarray:
    """Matrices of the jump, the motion cost and the looks' terms of all pairs of columns."""
    n = max(e["col"] for e in edges) + 1
    parts = np.full((2 + len(TERMS), n, n), np.nan)
    for e in edges:
        parts[:, e["col"], e["target"]] = [np.nan if e[k] is None else e[k] for k in ("jump_px", "cost", *TERMS)]
    return parts


def _solved(parts: np.ndarray, by_cost: bool, max_jump_px: float, weights: tuple[float, float, float]) -> tuple:
    n = parts.shape[1]
    before = _costs(parts[1:], np.arange(n), weights)
    if not by_cost or n < 2 or not before[1] > 0:
        return n, False, None, before if by_cost and n > 1 else None, None
    possible = parts[0] <= max_jump_px
    # Tracks without motion costs of their own can change places at no cost.
    flat = sum(bool(ok.any()) and (np.isnan(row).all() or np.ptp(row[ok]) == 0) for row, ok in zip(parts[1], possible))
    best = _first_cheapest(parts, possible, weights, flat > 1)
    return n, flat > 1, best, before, best and _costs(parts[1:], np.array(best), weights)


def _first_cheapest(parts: np.ndarray, possible: np.ndarray, weights: tuple[float, float, float], tied: bool) -> list[int] | None:
    """The cheapest permutation but the identity; of equal ones the first, found place by place."""
    motion, look = parts[1], np.tensordot(weights, parts[2:], 1)
    found = cheapest_other(motion, look, possible)
    if found is None:
        return None
    least, best = found
    for i in range(len(best) if tied else 0):
        for t in np.flatnonzero(possible[i]):
            held = possible.copy()
            held[i], held[:, t] = False, False
            held[i, t] = True
            other = cheapest_other(motion, look, held)
            if other and other[0] <= least * (1 + 1e-12):
                possible, best = held, other[1]
                break
    return [int(x) for x in best]


def decide(
    edges: DataFrame, blocks: DataFrame, verdicts: DataFrame | None, max_jump_px: float, ratio: float, max_block: int, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
) -> DataFrame:
    """Decide every block of a recording, in order: which permutation it commits, and at which cost.

    Edge costs are of the original labels. All blocks are solved in parallel; what meets in one group is a few
    numbers for each block of a recording, and there a running renaming turns permutations into those of the labels so far. The cost of
    a permutation is its mean motion cost and, by ``weights``, its means of ``look``, ``axis`` and ``area``
    where edges have them. Without three places on both sides a block swaps by verdict only.
    """
    whole = (F.col("rank_start") >= LEAST_WINDOW) & (F.col("rank_last") - F.col("rank_end") >= LEAST_WINDOW)
    spans = blocks.select(*SCENE, "block", "event_id", "frame_start", "frame_end", whole.alias("whole"), (F.col("rank_end") - F.col("rank_start") + 1).alias("length"), F.col("place_a").alias("col_a"), F.col("place_b").alias("col_b"))
    edges = edges.withColumns({t: F.lit(None).cast("double") for t in TERMS if t not in edges.columns})
    table = F.array_sort(F.collect_list(F.struct("col", "target", "jump_px", "cost", *TERMS))).alias("edges")
    rows = solve_blocks(spread(spans.join(edges.groupBy(*SCENE, "block").agg(table), [*SCENE, "block"])), max_jump_px, max_block, weights)
    if verdicts is None:
        rows = rows.withColumns({"verdict": F.lit(None).cast("string"), "swap": F.lit(None).cast("array<int>")})
    else:
        keys = [c for c in (*SCENE, "event_id") if c in verdicts.columns]
        given = verdicts.select(*keys, "verdict", "swap") if "swap" in verdicts.columns else verdicts.select(*keys, "verdict", F.lit(None).cast("array<int>").alias("swap"))
        rows = rows.join(given, keys, "left")

    names = [*SCENE, "block", "verdict", "perm", "now", *COSTS]
    kinds = {c: t for c, t in blocks.dtypes if c in (*SCENE, "block")}
    kinds |= {"verdict": "string", "perm": "array<int>", "now": "array<int>"} | dict.fromkeys(COSTS, "double")
    types = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}[kinds[c]]) for c in names])

    def run(group: pa.Table) -> pa.Table:
        out, sigma, now = [], None, None
        for row in sorted(group.to_pylist(), key=lambda r: r["block"]):
            n = row["n"]
            if n < 2:
                continue
            if sigma is None or len(sigma) != n:
                sigma = now = np.arange(n)
            unknown = [None] * (2 + len(TERMS))
            perm, before, after, kind = None, unknown, unknown, ""
            if row["verdict"] == "mount":
                kind = "mount"
            elif row["verdict"] == "accept_swap":
                kind, perm = "accept_swap", np.arange(n)
                if row["swap"] is not None and len(row["swap"]) == n:
                    perm = np.array(row["swap"])
                else:
                    a, b = row["col_a"], row["col_b"]
                    perm[[a, b]] = perm[[b, a]]
            elif row["verdict"] != "reject_swap" and row["best"] is not None:
                before, best, after = row["before"], np.array(row["best"]), row["after"]
                if row["tied"] and (sigma != np.arange(n)).any():
                    parts = _parts(row["edges"])[:, sigma[:, None], sigma]
                    found = np.array(_first_cheapest(parts, parts[0] <= max_jump_px, weights, True))
                    after = _costs(parts[1:], found, weights)
                else:
                    found = np.argsort(sigma)[best[sigma]]
                if after[0] < before[0] and after[0] <= ratio * before[0]:
                    kind, perm = "auto", found
            if kind:
                p = list(range(n)) if perm is None else [int(x) for x in perm]
                now = now if perm is None else perm[now]
                costs = zip(before, after) if kind == "auto" else zip(unknown, unknown)
                scene = [row[c] for c in SCENE]
                out.append((*scene, row["block"], kind, p, [int(x) for x in now], *(x for pair in costs for x in pair)))
            if perm is not None:
                sigma = sigma[perm]
        columns = zip(*out) if out else [[] for _ in names]
        return pa.table([pa.array(list(c), f.type, from_pandas=True) for c, f in zip(columns, types)], schema=types)

    return spread(rows, *SCENE).groupBy(*SCENE).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def _costs(parts: np.ndarray, perm: np.ndarray, weights: tuple[float, float, float]) -> list[float]:
    """Total of a permutation, then its mean motion cost and terms; a term that no edge has is 0, motion NaN."""
    chosen = parts[:, np.arange(len(perm)), perm]
    known = ~np.isnan(chosen)
    means = [float(c[k].mean()) if k.any() else 0.0 if i else np.nan for i, (c, k) in enumerate(zip(chosen, known))]
    return [means[0] + float(np.dot(weights, means[1:])), *means]


def relabel(df: DataFrame, decided: DataFrame, blocks: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rename tracks after each committed block; ``original_track_id`` keeps the first name.

    A block's map of names after it (``now``, as ``decide`` gives it, or composed here of the blocks
    before it) is carried forward over the rows as of their frame, without a range join. A block's
    permutation renames label ids[i] to ids[perm[i]].
    """
    ids = tracks.groupBy(*SCENE).agg(F.array_sort(F.collect_set("track_id")).alias("ids"))
    swaps = decided.filter(F.col("verdict").isin("auto", "accept_swap")).join(blocks.select(*SCENE, "block", "frame_end"), [*SCENE, "block"])
    if "now" not in swaps.columns:
        w = Window.partitionBy(*SCENE).orderBy("frame_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        name = lambda acc, p: F.transform(acc, lambda place: F.get(p, place))
        start = F.sequence(F.lit(0), F.size("perm") - 1)
        swaps = swaps.withColumn("now", F.aggregate(F.collect_list("perm").over(w), start, name))
    maps = swaps.join(ids, SCENE)
    renamed = F.explode(F.arrays_zip(F.col("ids").alias("track_id"), F.transform("now", lambda i: F.get(F.col("ids"), i)).alias("to")))
    maps = maps.select(*SCENE, (F.col("frame_end") + 1).alias(FRAME), renamed.alias("m")).select(*SCENE, FRAME, "m.track_id", "m.to")
    w = Window.partitionBy(*SCENE, "track_id").orderBy(FRAME).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = df.withColumn("_row", F.lit(True)).unionByName(maps, allowMissingColumns=True)
    carried = both.withColumn("_to", F.last("to", ignorenulls=True).over(w)).filter("_row")
    return carried.withColumns({"original_track_id": F.col("track_id"), "track_id": F.coalesce("_to", "track_id")}).drop("_row", "_to", "to")


def audit_tables(
    df: DataFrame, fps: float, px_per_mm: float, contact_mm: float = DEFAULTS["contact_mm"], window_s: float = DEFAULTS["audit_window_s"]
) -> tuple[DataFrame, DataFrame]:
    """The grid and the event blocks that an audit reads, kept as tables. Who needs the blocks for verdicts makes them here and hands both on."""
    positive(fps=fps, px_per_mm=px_per_mm, contact_mm=contact_mm)
    grid = keep(ranked_grid(df), "grid")
    blocks = blocks_with_pairs(event_frames(grid, contact_mm * px_per_mm), grid, _window(fps, window_s))
    place = _columns(grid).withColumnRenamed("col", "place")
    for side in ("a", "b"):
        blocks = blocks.join(place.withColumnsRenamed({"track_id": f"animal_{side}", "place": f"place_{side}"}), [*SCENE, f"animal_{side}"], "left")
    return grid, keep(blocks.join(grid.groupBy(*SCENE).agg(F.max("rank").alias("rank_last")), SCENE), "blocks")


def _window(fps: float, window_s: float) -> int:
    return max(3, round(window_s * fps))


def audit_tracks(
    df: DataFrame, fps: float, px_per_mm: float, contact_mm: float = DEFAULTS["contact_mm"], window_s: float = DEFAULTS["audit_window_s"],
    ratio: float = DEFAULTS["improve_ratio"], max_jump_px: float | None = None, max_block: int | None = None,
    verdicts: DataFrame | None = None, noise: Noise = Noise(), fingerprints: DataFrame | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0), made: tuple[DataFrame, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Repair identity swaps: the relabelled trajectory with ``original_track_id, event_type``, and the swap log.

    With ``fingerprints``, looks count beside motion, by ``weights`` for patch, axis ratio and area. The grid, blocks and decisions are kept as tables; they are read several times.
    ``made`` are the ``audit_tables`` of the same rows and settings, if they are there already.
    """
    positive(fps=fps, px_per_mm=px_per_mm, contact_mm=contact_mm, ratio=ratio)
    if ratio > 1 or min(weights) < 0:
        raise ValueError("the ratio can't be above 1, nor a weight below 0")
    window = _window(fps, window_s)
    max_jump_px = DEFAULTS["jump_contacts"] * contact_mm * px_per_mm if max_jump_px is None else max_jump_px
    max_block = DEFAULTS["block_windows"] * window if max_block is None else max_block
    grid, blocks = made or audit_tables(df, fps, px_per_mm, contact_mm, window_s)
    edges = edge_costs(window_samples(grid, blocks, window), blocks, noise)
    if fingerprints is not None:
        edges = edges.join(appearance_edges(fingerprints, grid, blocks, window), [*SCENE, "block", "col", "target"], "left")
    decided = keep(decide(edges, blocks, verdicts, max_jump_px, ratio, max_block, weights), "decided")
    out = relabel(df, decided, blocks, grid.select(*SCENE, "track_id").distinct())
    mounts = decided.filter("verdict = 'mount'").join(blocks.select(*SCENE, "block", "frame_start", "frame_end", "animal_a", "animal_b"), [*SCENE, "block"])
    log = decided.join(blocks.select(*SCENE, "block", "event_id", "frame_start", "frame_end"), [*SCENE, "block"]).select(
        *SCENE, F.col("frame_end").alias("frame_idx"), "event_id", "frame_start", "frame_end", "verdict", "perm",
        *COSTS, improvement_ratio(F.col("cost_before"), F.col("cost_after")).alias("improvement_ratio"),
    )
    return tag_mounts(out, mounts), log

