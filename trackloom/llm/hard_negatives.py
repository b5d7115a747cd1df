"""Hard negatives by a two-dimensional block matrix multiply.

Scores of all anchors with all rows are one matrix product. Anchors and rows are dealt into blocks, and
their dimensions into chunks; an anchor block, a row block and a chunk meet in one task, which returns a tile of partial
int64 scores. Tiles of a pair of blocks are added after a shuffle and reduced to a few rows of each anchor
at once, so no score leaves its tile but those that may be returned. First rows of the anchor's own label
meet it, dealt by label, which gives its positives; then all rows do, and each positive is a window of scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Sides of a tile and dimensions of a chunk.
ANCHORS, ROWS, DIMENSIONS = 512, 2048, 32

_TILE = "a long, b long, part int, anchors binary, rows binary, scores binary"


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, key, label, x: the distinct rows that take part, with whole components and a hash of these."""
    finite = F.coalesce(F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    whole = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    there = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    there = there.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("x"))
    return there.distinct().withColumn("key", F.xxhash64("label", "x"))


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer products of all rows of two matrices, by floating point where that is exact."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if most < 2**53:
        return np.rint(left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left @ right.T


def _packed(scores: np.ndarray) -> bytes:
    """The bytes of equal weight together, as most of them are alike."""
    return pa.compress(np.ascontiguousarray(scores.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, shape: tuple[int, int]) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * shape[0] * shape[1], codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).reshape(shape)


def _multiply(left: pa.Table, right: pa.Table) -> pa.Table:
    """The partial tile of an anchor block and a row block over one chunk of dimensions."""
    if not (left.num_rows and right.num_rows):
        return pa.table({n: pa.array([], t) for n, t in zip(("a", "b", "part", "anchors", "rows", "scores"), (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3))})
    sides = []
    for table in (left, right):
        table = table.sort_by([("vec_id", "ascending"), ("key", "ascending")])
        x = table.column("x").combine_chunks()
        who = np.stack([table.column(c).to_numpy() for c in ("vec_id", "key", "label")])
        sides.append((who.astype(np.int64), np.asarray(x.flatten()).astype(np.int64).reshape(table.num_rows, -1)))
    scores = product(sides[0][1], sides[1][1])
    first = left.slice(0, 1).to_pylist()[0]
    return pa.table(
        {
            "a": pa.array([first["a"]], pa.int64()), "b": pa.array([first["b"]], pa.int64()), "part": pa.array([first["part"]], pa.int32()),
            "anchors": pa.array([sides[0][0].tobytes()], pa.binary()), "rows": pa.array([sides[1][0].tobytes()], pa.binary()),
            "scores": pa.array([_packed(scores)], pa.binary()),
        }
    )


def _whole_tile(parts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors and rows (vec_id, key, label) of a pair of blocks, and the sums of their partial scores."""
    anchors, rows = (np.frombuffer(parts.column(c)[0].as_py(), np.int64).reshape(3, -1) for c in ("anchors", "rows"))
    total = np.zeros((anchors.shape[1], rows.shape[1]), np.int64)
    for data in parts.column("scores"):
        total += _unpacked(data.as_py(), total.shape)
    return anchors, rows, total


def _tiles(anchors: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """Partial tiles of the anchors and rows that have both block numbers, ``a`` and ``b``, in common."""
    chunk = lambda i: F.slice("x", i * DIMENSIONS + 1, DIMENSIONS)
    filled = lambda c, i: F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda j: F.coalesce(F.get(c, j), F.lit(0).cast("long")))
    # new columns: both sides come from one table
    cut = lambda df: df.select(*(F.col(c).alias(c) for c in ("a", "b", "vec_id", "key", "label")), F.posexplode(F.array(*[filled(chunk(i), i) for i in range(parts)])).alias("part", "x"))
    keys = ["a", "b", "part"]
    return cut(anchors).groupBy(*keys).cogroup(cut(rows).groupBy(*keys)).applyInArrow(_multiply, _TILE)


def _first(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """The ``most`` rows of greatest score, then least vec_id, of each group, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "key")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def _positives(parts: pa.Table, most: int) -> pa.Table:
    """Each anchor's best rows of its label in a tile, itself left out."""
    anchors, rows, scores = _whole_tile(parts)
    out = []
    for i in range(anchors.shape[1]):
        at = np.flatnonzero((rows[2] == anchors[2, i]) & ((rows[0] != anchors[0, i]) | (rows[1] != anchors[1, i])))
        at = at[np.lexsort((rows[1, at], rows[0, at], -scores[i, at]))[:most]]
        out.append(np.stack([np.full(len(at), anchors[0, i]), np.full(len(at), anchors[1, i]), rows[0, at], rows[1, at], scores[i, at]]))
    return pa.table(dict(zip(("anchor_id", "anchor_key", "vec_id", "key", "score"), map(pa.array, np.concatenate(out, axis=1)))))


def _negatives(tiles: pa.Table, windows: pa.Table, most: int, low: int, high: int) -> pa.Table:
    """Each window's best rows of another label in a tile."""
    names = ("anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score", "vec_id", "key", "score")
    asked: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for w in windows.select(["vec_id", "key", "positives"]).to_pylist():
        asked[w["vec_id"], w["key"]] = [(p["vec_id"], p["key"], p["score"]) for p in w["positives"]]
    out = [np.empty((len(names), 0), np.int64)]
    if tiles.num_rows and asked:
        anchors, rows, scores = _whole_tile(tiles)
        for i in range(anchors.shape[1]):
            positives = asked.get((int(anchors[0, i]), int(anchors[1, i])), ())
            floor = min((p[2] * low for p in positives), default=0)
            at = np.flatnonzero((rows[2] != anchors[2, i]) & (100 * scores[i] >= floor)) if positives else np.empty(0, np.int64)
            at = at[np.lexsort((rows[1, at], rows[0, at], -scores[i, at]))]
            falling = -100 * scores[i, at]
            for vec_id, key, score in positives:
                lo, hi = np.searchsorted(falling, -high * score, "left"), np.searchsorted(falling, -low * score, "right")
                here = at[lo : min(hi, lo + most)] if lo < hi else at[:0]
                known = [np.full(len(here), v) for v in (anchors[0, i], anchors[1, i], vec_id, key, score)]
                out.append(np.stack([*known, rows[0, here], rows[1, here], scores[i, here]]))
    return pa.table(dict(zip(names, map(pa.array, np.concatenate(out, axis=1)))))


def mine_hard_negatives(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """Rows of another label that score nearly as high with an anchor as one of its positives does.

    Needs ``vec_id`` (integer), ``label`` (integer) and ``embedding`` (array); other columns, whatever their names, are left
    alone. Components x become floor(scale * x); a score is the integer inner product with the anchor, exact while it fits
    64 bits. Anchors are the rows whose vec_id is divisible by ``every``; the first rows have the highest scores, ties
    by smaller vec_id, then by content. An anchor's positives are the first ``positives`` other rows of its
    label; of each, the first ``negatives`` rows of other labels with low * positive score <= 100 * score <= high *
    positive score are returned: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a null vec_id, label, vector or component, or one that isn't finite, take no part. Equal rows count once; rows that
    share a vec_id and differ are rows of their own, other than each other. A shorter vector counts as filled up with
    zeros. Anchors without positives, and windows without rows, give none; an empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    known = scratch.write(quantised(rows, scale), "rows")
    is_anchor = F.col("vec_id") % every == 0
    sizes = known.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("x")).alias("width")).first()
    parts = max(1, -(-(sizes["width"] or 0) // DIMENSIONS))
    a_blocks, b_blocks = max(1, -(-sizes["anchors"] // ANCHORS)), max(1, -(-sizes["n"] // ROWS))
    dealt: Callable = lambda n, *c: F.pmod(F.xxhash64(*(c or ("vec_id", "key"))), F.lit(n) if isinstance(n, int) else n)
    every_block = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    # Labels share blocks as far as they fit; a label with more rows has several, which all its anchors meet.
    bucket = known.withColumn("bucket", dealt(b_blocks, "label"))
    shares = bucket.groupBy("bucket").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / ROWS)).cast("long").alias("b_n"), F.greatest(F.lit(1), F.ceil(F.count_if(is_anchor) / ANCHORS)).cast("long").alias("a_n")
    )
    own = bucket.join(shares, "bucket")
    a = F.col("bucket") * a_blocks + F.col("a")  # a bucket has at most as many anchor blocks as the whole
    b = F.col("bucket") * b_blocks + F.col("b")
    meets = lambda df: df.withColumn("a", a).withColumn("b", b)
    own_anchors = meets(own.filter(is_anchor).withColumn("a", dealt(F.col("a_n"))).withColumn("b", every_block(F.col("b_n"))))
    own_rows = meets(own.filter("label is not null").withColumn("b", dealt(F.col("b_n"))).withColumn("a", every_block(F.col("a_n"))))
    tops = _tiles(own_anchors, own_rows, parts).groupBy("a", "b").applyInArrow(
        lambda t: _positives(t, positives), "anchor_id long, anchor_key long, vec_id long, key long, score long"
    )
    best = _first(tops, ["anchor_id", "anchor_key"], positives)
    windows = best.groupBy("anchor_id", "anchor_key").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "key", "score"))).alias("positives"))
    windows = scratch.write(windows.withColumnsRenamed({"anchor_id": "vec_id", "anchor_key": "key"}), "windows")

    all_anchors = known.filter(is_anchor).join(windows.select("vec_id", "key"), ["vec_id", "key"]).withColumn("a", dealt(a_blocks))
    tiles = _tiles(
        all_anchors.withColumn("b", every_block(F.lit(b_blocks).cast("long"))),
        known.withColumn("b", dealt(b_blocks)).withColumn("a", every_block(F.lit(a_blocks).cast("long"))),
        parts,
    )
    asked = windows.withColumn("a", dealt(a_blocks)).withColumn("b", every_block(F.lit(b_blocks).cast("long")))
    schema = "anchor_id long, anchor_key long, positive_id long, positive_key long, positive_score long, vec_id long, key long, score long"
    found = tiles.groupBy("a", "b").cogroup(asked.groupBy("a", "b")).applyInArrow(lambda t, w: _negatives(t, w, negatives, low, high), schema)
    mined = _first(found, ["anchor_id", "anchor_key", "positive_id", "positive_key"], negatives)
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
