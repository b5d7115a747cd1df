"""Bounded, reproducible samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(folds: int, fold: int):
    """Whether crc32 of the doc_id's text leaves ``fold`` modulo ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """At most ``most`` labelled ids outside the held-out fold, by least hash, with their texts.

    Returns ``doc_id, text, label``. Null labels don't count; of repeated ones the greatest does.
    """
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(folds, fold))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
