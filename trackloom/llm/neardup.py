"""MinHash near-duplicates with odd-sketch verification.

A document's set holds its distinct word shingles. Equal sets are one class from the start. MinHash
bands bring candidates together, odd sketches (parity bitmaps of the MinHash samples) estimate a
candidate pair's similarity from one XOR and population count, and full sets confirm what is left.

First each bucket's members are linked to its centre, the member that meets most others, and
components are labelled. In the buckets that still hold several components, each member meets the
other components, dealt into blocks of bounded number: one with a single member there by its sketch,
a larger one as a whole, in blocks of full sets. So each pair that shares a bucket is either tested or
already in one component, whatever the bucket's size; members that stay apart cost their number
squared in comparisons, spread over the blocks, but only pairs whose sketches are close become rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hot import join_by_hot
from .scratch import Scratch

BANDS, ROWS, BITS = 40, 5, 512
#: An estimate may fall short of the true similarity by this much, some five standard deviations.
SLACK = 0.17
#: Shingles that one NumPy pass holds at a time; of one side of a block of a component; of one matrix.
CHUNK, BLOCK, COLUMNS = 1_000_000, 200_000, 4096
#: Components of a bucket that one task compares its members with.
MET = 1_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words.

    Words are what white space (ASCII) separates, A-Z in lower case. A text with fewer words is one
    shingle; null and blank texts have none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = h[: len(h) - size + 1]
    for j in range(1, size):
        out = _mix(out + np.uint64(j)) + h[j : len(h) - size + 1 + j]
    return np.unique(_mix(out))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(20240229)
    return rng.randint(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.randint(0, 2**32, n, dtype=np.uint32)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, one row for each of the (non-empty) sets."""
    a, b = _permutations(BANDS * ROWS)
    flat = np.concatenate(sets)
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), len(a)), np.uint32)
    for i in range(len(a)):
        x = (low ^ b[i]) * a[i]
        x ^= (x >> np.uint32(15)) + high
        x *= np.uint32(0x9E3779B1)
        out[:, i] = np.minimum.reduceat(x, starts)
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.empty((len(sig), BANDS), np.uint64)
    for band in range(BANDS):
        x = np.full(len(sig), band, np.uint64)
        for r in range(ROWS):
            x = _mix(x * np.uint64(31) + sig[:, band * ROWS + r])
        keys[:, band] = x
    return keys.view(np.int64)


def odd_sketches(sig: np.ndarray) -> np.ndarray:
    """Parity bitmap of each row's MinHash samples, as 64-bit words."""
    bits, rows = np.zeros((len(sig), BITS), np.uint8), np.arange(len(sig))
    for i in range(sig.shape[1]):
        bits[rows, (_mix(sig[:, i] + (np.uint64(i + 1) << np.uint64(32))) % np.uint64(BITS)).astype(np.int64)] ^= 1
    return np.packbits(bits, axis=1).view(np.int64)


def most_odd_bits(similarity: float) -> int:
    """Set bits of the XOR of two sketches at which the similarity is estimated as this."""
    return math.floor(BITS / 2 * (1 - math.exp(-4 * BANDS * ROWS * (1 - similarity) / BITS)))


SIGNATURE = "doc_id long, doc long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"
#: Whether two sketches allow a link; it must never rule one out that holds.
Likely = Callable[[Column, Column], Column]


def _lists(values: np.ndarray, there: np.ndarray) -> pa.Array:
    """One list for each True of ``there``, else null; ``values`` has the lists' rows."""
    width = values.shape[1] if values.ndim == 2 else 0
    offsets = np.concatenate([[0], np.cumsum(there * width)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(values.reshape(-1), pa.int64()), mask=pa.array(~there)
    )


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row: key of the row, size and digest of its set, band keys and odd sketch (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list, docs: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = np.array([len(s) > 0 for s in sets])
            there = [s for s in sets if len(s)]
            sig = _signatures(there) if there else np.empty((0, BANDS * ROWS), np.uint32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(docs, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    _lists(_band_keys(sig), full),
                    _lists(odd_sketches(sig), full),
                ],
                names=["doc_id", "doc", "n_shingles", "set_key", "bands", "sketch"],
            )

        for batch in batches:
            ids, docs, sets, held = [], [], [], 0
            for doc_id, doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("doc").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                docs.append(doc)
                sets.append(shingle_set(text.as_py(), shingle))
                held += len(sets[-1])
                if held >= CHUNK:
                    yield flush(ids, docs, sets)
                    ids, docs, sets, held = [], [], [], 0
            if ids:
                yield flush(ids, docs, sets)

    return docs.select("doc_id", _row_key(docs), "text").mapInArrow(run, SIGNATURE)


def _row_key(docs: DataFrame) -> Column:
    """A key of id and text; equal rows have one key."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"]).alias("doc")


def _full_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """The shingle hashes of the documents in ``nodes`` (node, doc_id, set_key, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(t.as_py(), shingle) for t in part.column("text")]
                same = [
                    xxhash.xxh3_128_digest(s.tobytes()) == k.as_py() for s, k in zip(sets, part.column("set_key"))
                ]
                shingles = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)),
                    pa.array(np.concatenate(sets).view(np.int64), pa.int64()),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("sketch"), shingles], names=["node", "sketch", "shingles"]
                ).filter(pa.array(same))

    return (
        docs.select("doc_id", "text")
        .join(nodes, "doc_id")
        .select("node", "text", "set_key", "sketch")
        .mapInArrow(run, "node long, sketch array<long>, shingles array<long>")
    )


def alike_sketches(percent: int) -> Likely:
    """Whether two odd sketches estimate a similarity near the threshold or above."""

    def likely(left: Column, right: Column) -> Column:
        return sum((F.bit_count(left[i].bitwiseXOR(right[i])) for i in range(1, BITS // 64)), F.bit_count(left[0].bitwiseXOR(right[0]))) <= most_odd_bits(percent / 100 - SLACK)

    return likely


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, likely: Likely) -> DataFrame:
    """The pairs whose sketches allow a link and whose full sets confirm it."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("sketch").alias(f"sketch_{k}"))
    full = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").filter(likely(F.col("sketch_a"), F.col("sketch_b"))).select("a", "b")
    both = close.join(full("b"), "b").join(full("a"), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    sized = both.select("a", "b", shared.alias("n"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return sized.filter(100 * F.col("n") >= percent * (F.col("total") - F.col("n"))).select("a", "b")


def _meetings(multi: DataFrame, labels: DataFrame, sets: DataFrame, likely: Likely) -> DataFrame:
    """What is left to compare in buckets with several components: x with y, or (y NULL) with a component.

    Of two components in a bucket the one with fewer members there is on the left; it meets the other
    as a pair if both have one member, and if the sketches allow a link.
    """
    now = multi.select("bucket", "node").join(labels, "node", "left")
    now = now.select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    rest = now.join(mixed.select("bucket"), "bucket").join(sets.select("node", "sketch"), "node")
    groups = rest.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min(F.struct("node", "sketch")).alias("one"))
    blocks = groups.groupBy("bucket").agg(F.ceil(F.count("*") / MET).cast("int").alias("blocks"))
    right = groups.join(blocks, "bucket").select("bucket", F.pmod(F.xxhash64("label"), F.col("blocks")).cast("int").alias("block"), F.col("label").alias("y_label"), F.col("n").alias("y_n"), F.when(F.col("n") == 1, F.col("one.node")).alias("y"), F.col("one.sketch").alias("y_sketch"))
    left = rest.join(groups.select("bucket", "label", "n"), ["bucket", "label"]).withColumnsRenamed({"node": "x", "label": "x_label", "n": "x_n", "sketch": "x_sketch"})
    left = left.join(blocks, "bucket").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    smaller = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_label") < F.col("y_label")))
    close = (F.col("y_n") > 1) | likely(F.col("x_sketch"), F.col("y_sketch"))
    met = left.join(right, (left["bucket"] == right["bucket"]) & (left["block"] == right["block"]) & smaller & close)
    return met.select("x", "y", F.when(F.col("y").isNull(), F.col("y_label")).alias("component")).distinct()


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of membership matrices."""
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    at = []
    for values, n in zip(flat, sizes):
        place = np.searchsorted(both, values)
        there = np.zeros(len(values), bool)
        there[place < len(both)] = both[place[place < len(both)]] == values[place < len(both)]
        at.append((np.repeat(np.arange(len(n)), n)[there], place[there]))
    for lo in range(0, len(both), COLUMNS):
        parts = []
        for (row, col), n in zip(at, sizes):
            m = np.zeros((len(n), min(COLUMNS, len(both) - lo)), np.float32)
            here = (col >= lo) & (col < lo + COLUMNS)
            m[row[here], col[here] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _linked_to_components(asked: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents and members of the components that they are asked for (x, component).

    Both sides are dealt into blocks of bounded size, and each pair of blocks is one group.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [(t.column("node").to_numpy(), [np.asarray(s.values).view(np.uint64) for s in t.column("shingles").combine_chunks()]) for t in (left, right)]
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(sides[0][0]) and len(sides[1][0]):
            n = _shared(sides[0][1], sides[1][1])
            total = np.add.outer([len(s) for s in sides[0][1]], [len(s) for s in sides[1][1]])
            i, j = np.nonzero(100 * n >= percent * (total - n))
            a, b = sides[0][0][i], sides[1][0][j]
        # A document's first link is enough to join the component.
        first = np.unique(a, return_index=True)[1]
        return pa.table({"a": a[first], "b": b[first]})

    member = labels.join(asked.select(F.col("component").alias("label")).distinct(), "label")
    member = member.select(F.col("label").alias("component"), "node").unionByName(
        asked.select("component", F.col("component").alias("node")).distinct()
    )
    member = member.join(sets.select("node", "shingles"), "node")
    asking = asked.withColumnRenamed("x", "node").join(sets.select("node", "shingles"), "node")
    blocks = lambda df, name: df.groupBy("component").agg(F.ceil(F.sum(F.size("shingles")) / BLOCK).cast("int").alias(name))
    counts = blocks(member, "m_blocks").join(blocks(asking, "x_blocks"), "component")

    def dealt(df: DataFrame, own: str, other: str, own_blocks: str, other_blocks: str) -> DataFrame:
        df = df.join(counts, "component").withColumn(own, F.pmod(F.xxhash64("node"), F.col(own_blocks)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1))).select(
            *[F.col(c).alias(c) for c in ("component", "m", "x", "node", "shingles")]  # new columns: both sides come from the same tables
        )

    keys = ["component", "m", "x"]
    left = dealt(asking, "x", "m", "x_blocks", "m_blocks").groupBy(*keys)
    right = dealt(member, "m", "x", "m_blocks", "x_blocks").groupBy(*keys)
    return left.cogroup(right).applyInArrow(run, "a long, b long")


def linked(multi: DataFrame, pairs: DataFrame | None, sets: DataFrame, percent: int, likely: Likely, scratch: Scratch) -> DataFrame:
    """Components (node, label) of the links between members of one bucket (bucket, node), and of ``pairs`` (a, b) besides.

    ``sets`` has node, sketch and shingles. A bucket's members meet the one of them that has most company; what is
    then outside its component meets the bucket's other components.
    """
    company = multi.groupBy("bucket").agg(F.count("*").alias("n"))
    counted = multi.select("bucket", "node").join(company, "bucket")
    weights = counted.groupBy("node").agg(F.sum("n").alias("weight"))
    centre = counted.join(weights, "node").groupBy("bucket").agg(F.min(F.struct(-F.col("weight"), "node")).alias("c"))
    star = counted.join(centre.select("bucket", F.col("c.node").alias("c")), "bucket").filter("node <> c")
    star = star.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
    tested = scratch.write((star.unionByName(pairs) if pairs is not None else star).distinct(), "tested")
    links = scratch.write(_verified(tested, sets, percent, likely), "links")
    labels = connected_components(links, scratch, "cc0")

    met = scratch.write(_meetings(multi, labels, sets, likely), "meetings")
    left = met.filter("component is null").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    left = left.distinct().join(tested, ["a", "b"], "left_anti")
    asked = met.filter("component is not null").select("x", "component")
    more = _verified(left, sets, percent, likely).unionByName(_linked_to_components(asked, labels, sets, percent))
    stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return connected_components(stars.unionByName(scratch.write(more, "more")), scratch, "cc1")


def spread(sig: DataFrame, reps: DataFrame, shared_ids: bool, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The component of every row of ``sig``, from the labels of its class; written as the one table that stays."""
    loose = F.col("set_key").isNull() | F.col("doc_id").isNull()
    groups = reps.join(labels, "node", "left").select("set_key", "copies", "doc_id", F.coalesce("label", "node").alias("component_id"))
    if shared_ids:  # a component's least node needn't be its least doc_id
        groups = scratch.write(groups, "groups")
        least = groups.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("classes"))
        groups = join_by_hot(groups, least, "component_id", "classes", groups.count()).select("set_key", "copies", F.col("least").alias("component_id"))
    rows = sig.filter(~loose).select("doc_id", "doc", "n_shingles", "set_key")
    joined = join_by_hot(rows, groups.select("set_key", "copies", "component_id"), "set_key", "copies", rows.count())
    alone = sig.filter(loose).select("doc_id", "doc", "n_shingles", F.col("doc_id").alias("component_id"))
    out = joined.select("doc_id", "doc", "n_shingles", "component_id").unionByName(alone)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    out = scratch.write(out.select("doc_id", "doc", "n_shingles", "component_id", kept), "result")
    scratch.keep_only("result")
    return out


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(spark, "neardup")
    sig = scratch.write(signatures(docs, shingle), "signatures")
    linkable = sig.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    one = [F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")]
    reps, shared_ids = _numbered(scratch.write(linkable.groupBy("set_key").agg(*one), "classes"), scratch)

    members = reps.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    multi = scratch.write(members.join(buckets.select("bucket"), "bucket"), "buckets")
    nodes = reps.join(multi.select("node").distinct(), "node").select("node", "doc_id", "set_key", "sketch")
    sets = scratch.write(_full_sets(docs, nodes, shingle).dropDuplicates(["node"]), "sets")
    return spread(sig, reps, shared_ids, linked(multi, None, sets, percent, alike_sketches(percent), scratch), scratch)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Needs ``doc_id`` (integer) and ``text``; other columns, whatever their names, are left alone.
    Returns one row for each input row: ``doc_id, n_shingles, component_id, kept``. The component is
    the least doc_id reachable over links. Null and blank texts have an empty set and no links. Rows
    that share a doc_id are each judged by their own text. A null doc_id has no component (null) and
    is kept. An empty table gives an empty result.
    """
    return _grouped(docs, shingle, percent).drop("doc")


def _numbered(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """The classes with a number each, ``node``: the least doc_id, and a hash for a class that shares it with another."""
    again = classes.groupBy("doc_id").agg(F.min("set_key").alias("own"), F.count("*").alias("n")).filter("n > 1").drop("n")
    if not again.limit(1).count():
        return classes.withColumn("node", F.col("doc_id")), False
    node = F.when(F.col("own").isNull() | (F.col("own") == F.col("set_key")), F.col("doc_id")).otherwise(F.xxhash64("set_key"))
    return scratch.write(classes.join(again, "doc_id", "left").withColumn("node", node).drop("own"), "numbered"), True


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those that another document of their group stands for.

    Rows that share a doc_id are each judged by their own text, so one may go and another stay; equal rows
    stay or go together. Null and blank texts and rows without a doc_id stay.
    """
    gone = _grouped(docs, shingle, percent).filter(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("doc").alias("__doc")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == F.col("__gone")) & (_row_key(docs) == F.col("__doc")), "left_anti")
