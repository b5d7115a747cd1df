"""Connected components of an undirected link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and the neighbours below it are linked to the least of them. Edges point down: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Label every linked node with the least node id that it can reach.

    ``links`` has two id columns ``a`` and ``b``; order, repeats and loops don't matter. Returns
    ``node, label`` for the nodes that aren't their own label; an empty link table gives an empty
    result. Each round is a table in the scratch folder, so lineage stays one round long.
    """
    edges = (
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    edges = scratch.write(edges, f"{name}-0")
    mark, step = _print(edges), 0
    while mark[0]:
        step += 1
        down = _large_star(edges).filter("u <> v").distinct()
        nxt = scratch.write(_small_star(down).filter("u <> v").distinct(), f"{name}-{step}")
        now = _print(nxt)
        scratch.drop(f"{name}-{step - 1}")
        edges = nxt
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
