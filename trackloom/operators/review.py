"""Human verdicts: store, merge with candidates and swap log, apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_number, event_pair, int_list, is_permutation, merge_tokens, review_status, source_tokens
from ..schema import FRAME, KEY, VERDICT_KINDS

SCENE = KEY[:2]
#: What the queue takes over from the swap log, as far as it is there.
LOGGED = ("cost_before", "cost_after", "cost_kalman_before", "cost_kalman_after", "cost_appearance_before", "cost_appearance_after", "permutation")


def upsert_verdicts(store: DataFrame, new: DataFrame) -> DataFrame:
    """Both, with a new verdict in place of an old one of the same event."""
    keys = [c for c in (*SCENE, "event_id") if c in store.columns]
    return store.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest_verdicts(log: DataFrame) -> DataFrame:
    """Of an append-only verdict log the last row of each event: by time, then by all else."""
    keys = [c for c in (*SCENE, "event_id") if c in log.columns]
    rest = [c for c in log.columns if c not in keys]
    row = F.struct(*rest)
    return log.groupBy(*keys).agg(F.max_by(row, F.struct("timestamp_iso", *[c for c in rest if c != "timestamp_iso"])).alias("v")).select(*keys, "v.*")


def check_verdicts(df: DataFrame) -> DataFrame:
    """Add ``problem``: why a verdict can't be applied, NULL if it can.

    Start and end in the wrong order are turned round. A permutation must hold its own ids and change
    some; the first two that it changes become the pair.
    """
    perm = int_list(F.col("permutation"))
    sorted_ids = F.array_sort(perm)
    moved = F.filter(F.transform(F.arrays_zip(sorted_ids.alias("f"), perm.alias("t")), lambda p: F.when(p["f"] != p["t"], p["f"])), lambda v: v.isNotNull())
    given = F.coalesce(F.trim("permutation"), F.lit("")) != ""
    problem = (
        F.when(~F.col("verdict").isin(*VERDICT_KINDS), "unknown verdict")
        .when(given & perm.isNull(), "permutation is not a list of ids")
        .when(given & (F.size(F.array_distinct(perm)) < F.size(perm)), "permutation repeats an id")
        .when(given & ~is_permutation(perm, sorted_ids), "not a permutation")
        .when(given & (F.size(moved) == 0), "permutation changes nothing")
        .when(~given & (F.col("animal_a") == F.col("animal_b")), "one animal twice")
    )
    return df.withColumns(
        {
            "problem": problem,
            "frame_start": F.least("frame_start", "frame_end"),
            "frame_end": F.greatest("frame_start", "frame_end"),
            "animal_a": F.when(F.size(moved) >= 2, moved[0]).otherwise(F.col("animal_a")),
            "animal_b": F.when(F.size(moved) >= 2, moved[1]).otherwise(F.col("animal_b")),
        }
    )


def merge_review(candidates: DataFrame, audit: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per event over candidates, swap log and verdicts; by recording, where all three tell it.

    Sources keep the order in which candidates name them. Frames and animals come from candidates, else from the log, else from verdicts. Of repeated
    candidates the first row (by start, end) gives the base and all give sources and extremes; of log
    and verdict rows the last one holds (by frame; by time).
    """
    keys = [c for c in (*SCENE, "event_id") if all(c in df.columns for df in (candidates, audit, verdicts))]
    base = F.struct("frame_start", "frame_end", "animal_a", "animal_b")
    parts = source_tokens(F.col("source"))
    listed = candidates.filter(F.col("event_id") != "")
    listed = listed.withColumn("n_frames", F.lit(None).cast("int")) if "n_frames" not in listed.columns else listed
    c = listed.groupBy(*keys).agg(
        F.min(base).alias("c"),
        F.array_sort(F.collect_list(F.struct("frame_start", "frame_end", parts.alias("t")))).alias("c_src"),
        F.min(clean_number(F.col("min_distance_px"))).alias("min_distance_px"),
        F.max(clean_number(F.col("max_jump_px"))).alias("max_jump_px"),
        F.max("n_frames").alias("n_frames"),
    )
    pair = event_pair(F.col("event_id"))
    log = audit.filter(F.coalesce("event_id", F.lit("")) != "").withColumns({"_a": pair["a"], "_b": pair["b"]})
    terms = [n for n in LOGGED if n in log.columns]
    row = F.struct(F.greatest("frame_start", F.lit(0)).alias("frame_start"), "frame_end", F.col("_a").alias("animal_a"), F.col("_b").alias("animal_b"), *terms, F.col("verdict").alias("logged"), (F.col("verdict") != "mount").alias("committed"))
    a = log.groupBy(*keys).agg(F.max_by(row, "frame_idx").alias("a"))
    held = F.struct("frame_start", "frame_end", "animal_a", "animal_b", "verdict", "reviewer", "note", "timestamp_iso")
    v = verdicts.groupBy(*keys).agg(F.max_by(held, F.struct("timestamp_iso", "verdict")).alias("v"))
    out = c.join(a, keys, "full").join(v, keys, "full")
    tokens = merge_tokens(
        F.flatten(F.transform("c_src", lambda r: r["t"])), F.when(F.col("a").isNotNull(), F.array(F.lit("audit"))), F.when(F.col("v").isNotNull(), F.array(F.lit("verdict")))
    )
    return out.select(
        *keys,
        *[F.coalesce(f"c.{n}", f"a.{n}", f"v.{n}").alias(n) for n in ("frame_start", "frame_end", "animal_a", "animal_b")],
        F.array_join(tokens, ",").alias("sources"),
        "min_distance_px",
        "max_jump_px",
        "n_frames",
        *[(clean_number(F.col(f"a.{n}")) if n.startswith("cost") else F.col(f"a.{n}")).alias(n) for n in terms],
        F.coalesce("a.committed", F.lit(False)).alias("audit_committed"),
        F.col("a.logged").alias("audit_verdict"),
        F.col("v.verdict").alias("verdict"),
        F.col("v.reviewer").alias("reviewer"),
        F.col("v.note").alias("note"),
        F.col("v.timestamp_iso").alias("timestamp_iso"),
        review_status(F.col("v.verdict"), F.col("a.committed")).alias("status"),
    )


def review_totals(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count("*").alias("total"), F.count_if(F.col("verdict").isNotNull()).alias("done"), F.count_if(F.col("verdict").isNull()).alias("pending")
    )


def unmatched_verdicts(verdicts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Verdicts whose event no longer exists; an audit would ignore them."""
    keys = [c for c in (*SCENE, "event_id") if c in verdicts.columns and c in blocks.columns]
    return verdicts.join(blocks.select(*keys).distinct(), keys, "left_anti")


def tag_mounts(df: DataFrame, mounts: DataFrame, original: str = "original_track_id") -> DataFrame:
    """Set ``event_type`` to mount on the rows of the pair in each mount's frames, else to the empty text.

    Mounts are spread over their frames, so the join is on equal keys; ids are those before any swap.
    """
    cells = (
        mounts.withColumn(FRAME, F.explode(F.sequence("frame_start", "frame_end")))
        .withColumn(original, F.explode(F.array("animal_a", "animal_b")))
        .select(*[c for c in SCENE if c in mounts.columns], FRAME, original).distinct()
    )
    keys = cells.columns
    tagged = df.drop("event_type").join(cells.withColumn("_m", F.lit("mount")), keys, "left")
    return tagged.withColumn("event_type", F.coalesce("_m", F.lit(""))).drop("_m")


def without_mounts(df: DataFrame) -> DataFrame:
    """Rows that aren't tagged as mount; untagged rows stay."""
    return df.filter(~F.col("event_type").eqNullSafe("mount"))
