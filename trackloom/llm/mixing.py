"""Mixing sources to target weights.

Documents get hash-random keys. A source is sorted by key in slices of the key range, so that no
sort or running sum meets a whole source in one task: token counts are summed per slice, prefix
sums run over slices, then inside each slice, and the source is cut at its exact budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Slices of the key range; a source with 10^10 documents has 2.4 million in each.
SLICES = 4096
KEY_HEX = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], total: float, most: float) -> DataFrame:
    """Targets of the sources in ``sizes`` (src, source, source_size).

    Weights repeat over the sources by code point, null last. All targets together are ``total`` of
    all sizes, shared by weight; none is above ``most`` times its source's size, and what a source
    can't take is shared among the others by weight again. One row per source meets in one task.
    """
    everything = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("n", F.row_number().over(everything))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("double"))
    # In order of limit over weight: a source is full if the level, were it not full, would be above its limit.
    order = Window.orderBy(F.col("source_size") * F.lit(most) / F.col("weight"), "n")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("source_size") * F.lit(most)
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(total) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= limit)
    open_level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("full"), limit).otherwise(open_level * F.col("weight"))
    return levels.select("src", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), total: float = 1.0, most: float = 3.0, slices: int = SLICES
) -> DataFrame:
    """Choose how many words of each document a mix takes so that each source comes to its target.

    Needs ``doc_id, source, text``; adds ``size, source_size`` (words), ``target`` (the source's) and
    ``taken`` to the columns of ``docs``, in place of any of these names. A source is repeated in whole
    epochs; the rest of its budget, rounded to whole words, goes to its documents by key, the last one in part. Null
    texts have size 0 and are never taken; null is a source of its own; a key is the hash of doc_id and
    text, so rows that share a doc_id or have none are spread, and ties are rows alike; an empty table gives an empty result. Reruns agree.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    sized = docs.withColumns({"size": word_count(F.col("text")), "__mix_src": src, "__mix_key": F.conv(F.substring(key, 1, KEY_HEX), 16, 10).cast("long")})
    sized = sized.withColumn("__mix_slice", F.shiftright("__mix_key", 4 * KEY_HEX - (slices.bit_length() - 1)).cast("int"))

    parts = sized.groupBy("__mix_src", "source", "__mix_slice").agg(F.sum("size").alias("slice_size"))
    sums = parts.groupBy(F.col("__mix_src").alias("src"), "source").agg(F.sum("slice_size").alias("source_size"))
    targets = source_targets(sums, weights, total, most)
    ahead = Window.partitionBy("__mix_src").orderBy("__mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__mix_src", "__mix_slice", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("__mix_offset"))
    budget = F.least(F.round("target").cast("long"), (F.col("source_size") * F.lit(most)).cast("long"))
    offsets = offsets.join(targets.withColumnRenamed("src", "__mix_src"), "__mix_src").withColumn("__mix_budget", budget)

    within = Window.partitionBy("__mix_src", "__mix_slice").orderBy("__mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(offsets, ["__mix_src", "__mix_slice"])
    start = F.col("__mix_offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("__mix_budget") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("__mix_budget") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - start))
    taken = (epochs * F.col("size") + part).cast("long")
    return placed.withColumn("taken", taken).select(*docs.columns, "size", "source_size", "target", "taken")
