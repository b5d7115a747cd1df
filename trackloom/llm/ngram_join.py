"""Jaccard self-join of word n-gram sets by a partition of the token universe.

Two sets of s and t shingles with a similarity of p percent differ in H = (s + t)(100 - p) / (100 + p)
shingles at most. Sizes fall into bands, so that a partner's size is in the same band or the next one.
A band's universe is cut into m > H segments by hash; of segments with shares v that add up to H + 1 or
more, one at least differs in fewer than v shingles (pigeonhole). So the larger set of a pair spends
H + 1 shares on its segments: one for a segment whose subset must be equal, two for one that may
differ in a shingle, which their one-deletion neighbourhoods find, none for the rest. Shares go where they
cost least: rows of the index, and sets of the band that would be met by chance.

Keys that two sets share make buckets. What meets there is told apart by parity bitmaps of whole
sets, whose XOR never has more bits than the sets have differences, and is verified on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .neardup import CHUNK, Likely, _full_sets, _mix, _numbered, _row_key, linked, shingle_set, spread
from .scratch import Scratch

#: Largest set, spare segments of a band (a part of H + 1, and so many more), segments whose one-deletion neighbourhoods are indexed.
LARGEST, SPARE, SPARE_LEAST, DELETED_LEAST, DELETED_PART = 2**31, 0.12, 2, 2, 32
#: Assumed chance that a set of the band holds a given shingle of another one; only costs depend on it.
COMMON = 0.05
#: Digests of sets that a task keeps in mind, so as not to index copies again.
REMEMBERED = 200_000


class Plan(NamedTuple):
    """Bands by least size, their number of segments, those with one-deletion neighbourhoods, and costs by subset size."""

    percent: int
    least: np.ndarray
    segments: np.ndarray
    deleted: np.ndarray
    cost: np.ndarray


def most_differences(total, percent: int):
    """Elements that two sets of this total size can differ in at this similarity."""
    return total * (100 - percent) // (100 + percent)


def band_starts(percent: int) -> list[int]:
    """Least sizes of the bands: the least partner of a band's set is in the band below at the lowest."""
    out = [1]
    while out[-1] < LARGEST:
        out.append(max(out[-1] + 1, 100 * (out[-1] - 1) // percent + 1))
    return out


def plan(percent: int, sets_in_band: dict[int, int]) -> Plan:
    least = np.array(band_starts(percent), np.int64)
    top = np.append(least[1:], LARGEST * 2) - 1
    most = most_differences(top + 100 * top // percent, percent)
    segments = np.where(most > 0, most + 1 + np.ceil(SPARE * (most + 1)).astype(np.int64) + SPARE_LEAST, 0)
    deleted = np.minimum(segments, DELETED_LEAST + segments // DELETED_PART)
    size = np.arange(64)
    met = np.array([sets_in_band.get(int(i), 0) for i in range(len(least))], float)[:, None]
    exact = 1 + met * COMMON**size
    near = 1 + size + met * size * COMMON ** np.maximum(size - 1, 0)
    # A second share never costs less than the first of the same segment, so shares are taken in order.
    return Plan(percent, least, segments, deleted, np.stack([exact, np.maximum(near, exact)]))


def _ranks(owner: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Place of each entry among its owner's by cost."""
    order = np.lexsort((cost, owner))
    starts = np.searchsorted(owner[order], np.arange(owner.max() + 1 if len(owner) else 0))
    out = np.empty(len(owner), np.int64)
    out[order] = np.arange(len(owner)) - starts[owner[order]]
    return out


def segment_keys(sets: list[np.ndarray], p: Plan, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of (non-empty) sets in their own band's index, or in the band below as a prober: key, set's number, probing."""
    nothing = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    size = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted(p.least, size, "right") - 1
    target = band - lower
    top = np.append(p.least[1:], LARGEST * 2)[target] - 1
    most = most_differences(size + np.minimum(size, top), p.percent)
    there = (target >= 0) & (100 * top >= p.percent * size) & (p.segments[target] > 0) & (~np.bool_(lower) | (most > 0))
    at = np.flatnonzero(there)
    if not len(at):
        return nothing
    size, target, most = size[at], target[at], most[at]
    flat, owner, m = np.concatenate([sets[i] for i in at]), np.repeat(np.arange(len(at)), size), p.segments[target]
    base = np.concatenate([[0], np.cumsum(m)])
    segment = (((flat >> np.uint64(32)) * m[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    group = base[owner] + segment  # in order, as sets are sorted
    count = np.bincount(group, minlength=base[-1])
    ends = np.cumsum(count)
    mixed = _mix(flat)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    total = sums[ends] - sums[ends - count]
    g_owner = np.repeat(np.arange(len(at)), m)
    g_segment = np.arange(base[-1]) - base[g_owner]
    salt = _mix((target[g_owner].astype(np.uint64) << np.uint64(32)) + g_segment.astype(np.uint64) + np.uint64(1))

    # Shares: first ones of all segments, then second ones of those with neighbourhoods.
    second = np.flatnonzero(g_segment < p.deleted[target][g_owner])
    short = np.minimum(count, p.cost.shape[2] - 1)
    costs = np.concatenate([p.cost[0, target[g_owner], short], p.cost[1, target[g_owner[second]], short[second]]])
    taken = _ranks(np.concatenate([g_owner, g_owner[second]]), costs) < np.where(most > 0, most + 1, 0)[np.concatenate([g_owner, g_owner[second]])]
    one, two = taken[: len(count)], np.zeros(len(count), bool)
    two[second] = taken[len(count) :]

    full = one if lower else np.ones(len(count), bool)
    with_deletions = two if lower else g_segment < p.deleted[target][g_owner]
    element = np.flatnonzero(with_deletions[group])
    keys = np.concatenate([_mix(total[full] + salt[full]), _mix(total[group[element]] - mixed[element] + salt[group[element]])])
    number = at[np.concatenate([g_owner[full], owner[element]])]
    return keys, number, np.concatenate([one[full], two[group[element]]])


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens' numbers in about as many cells, a power of two; a wider one folds onto a narrower."""
    words = 1 << max(0, (len(tokens) - 1) // 64).bit_length()
    cell = (tokens & np.uint64(words * 64 - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=words * 64) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def few_differences(percent: int) -> Likely:
    """Whether sizes and bitmaps (an array of the size and the bitmap's words) leave a link possible; never wrong about a link."""

    def likely(a: Column, b: Column) -> Column:
        width = F.least(F.size(a), F.size(b)) - 1
        folded = lambda x, i: F.get(x, i).bitwiseXOR(F.when(F.size(x) - 1 > width, F.get(x, i + width)).otherwise(F.lit(0)))
        bits = F.aggregate(F.sequence(F.lit(1), width), F.lit(0), lambda acc, i: acc + F.bit_count(folded(a, i).bitwiseXOR(folded(b, i))))
        sized = 100 * F.least(a[0], b[0]) >= percent * F.greatest(a[0], b[0])
        return F.when(sized, bits * (100 + percent) <= (a[0] + b[0]) * (100 - percent)).otherwise(F.lit(False))

    return likely


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _half(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _sized(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row: key of the row, size and digest of its set, half of the digest, and the set's size with its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            digests = [_digest(s) if len(s) else None for s in sets]
            columns = [
                batch.column("doc_id"), batch.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                pa.array([d and _half(d) for d in digests], pa.int64()),
                pa.array([np.concatenate([[len(s)], parity_bitmap(s)]) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc", "n_shingles", "set_key", "half", "sketch"])

    schema = "doc_id long, doc long, n_shingles long, set_key binary, half long, sketch array<long>"
    return docs.select("doc_id", _row_key(docs), "text").mapInArrow(run, schema)


def _keys(docs: DataFrame, shingle: int, p: Plan) -> DataFrame:
    """Index entries and probes of all sets, copies within a task once: key, doc_id and half (whose set), probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list, halves: list, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            doc, half = np.array(ids, np.int64), np.array(halves, np.int64)
            for lower in (False, True):
                key, number, probe = segment_keys(sets, p, lower)
                for lo in range(0, len(key), CHUNK // 4):
                    here = slice(lo, lo + CHUNK // 4)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[here].view(np.int64)), pa.array(doc[number[here]]), pa.array(half[number[here]]), pa.array(probe[here])],
                        names=["key", "doc_id", "half", "probe"],
                    )

        seen, ids, halves, sets, held = set(), [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                tokens = shingle_set(text.as_py(), shingle)
                digest = _digest(tokens)
                if not len(tokens) or digest in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(digest)
                ids.append(doc_id)
                halves.append(_half(digest))
                sets.append(tokens)
                held += len(tokens)
                if held >= CHUNK // 2:
                    yield from flush(ids, halves, sets)
                    ids, halves, sets, held = [], [], [], 0
        if ids:
            yield from flush(ids, halves, sets)

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "key long, doc_id long, half long, probe boolean")


def _met(keys: DataFrame) -> DataFrame:
    """Keys that several sets share, one of them probing; keys with the same sets are one bucket (bucket, doc_id, half)."""
    w, who = Window.partitionBy("key"), F.xxhash64("doc_id", "half")
    seen = keys.select(
        "doc_id", "half", F.min("half").over(w).alias("lo"), F.max("half").over(w).alias("hi"),
        F.max("probe").over(w).alias("probed"), F.count("*").over(w).alias("n"), F.bit_xor(who).over(w).alias("all"),
    )
    return seen.filter("lo <> hi and probed").select(F.xxhash64("lo", "hi", "n", "all").alias("bucket"), "doc_id", "half").distinct()


def ngram_join(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Join documents whose sets of ``shingle`` consecutive words have a Jaccard similarity of ``percent`` / 100 or more.

    Needs ``doc_id`` (integer) and ``text``; other columns, whatever their names, are left alone. Words are what
    ASCII white space separates, A-Z in lower case. Returns one row for each input row: ``doc_id,
    n_shingles, component_id``, the least doc_id reachable over links. A text with fewer words is one shingle;
    null and blank texts have an empty set and no links. Rows that share a doc_id are each judged by their own
    text; a null doc_id has no component (null). The join is exact: no pair at the threshold can be lost, whatever the
    texts. An empty table gives an empty result.
    """
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(spark, "ngrams")
    sig = scratch.write(_sized(docs, shingle), "sized")
    linkable = sig.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    one = [F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")]
    reps, shared_ids = _numbered(scratch.write(linkable.groupBy("set_key").agg(*one), "classes"), scratch)
    starts = band_starts(percent)
    band = sum((F.col("sketch")[0] >= s).cast("int") for s in starts[1:])
    counts = {r["band"]: r["n"] for r in reps.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}

    met = scratch.write(_met(_keys(docs, shingle, plan(percent, counts))), "met")
    ids = met.select("doc_id", "half").distinct().join(linkable.select("doc_id", "half", "set_key").distinct(), ["doc_id", "half"])
    ids = ids.join(reps.select("set_key", "node"), "set_key").select("doc_id", "half", "node")
    members = scratch.write(met.join(ids, ["doc_id", "half"]).select("bucket", "node").distinct(), "members")
    scratch.drop("met")

    # A bucket of two is a pair; larger ones have their members linked as buckets.
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
    likely, known = few_differences(percent), lambda k: reps.select(F.col("node").alias(k), F.col("sketch").alias(f"sketch_{k}"))
    pairs = sizes.filter("n = 2").select("a", "b").distinct().join(known("a"), "a").join(known("b"), "b")
    pairs = scratch.write(pairs.filter(likely(F.col("sketch_a"), F.col("sketch_b"))).select("a", "b"), "pairs")
    multi = scratch.write(members.join(sizes.filter("n > 2").select("bucket"), "bucket"), "buckets")
    asked = multi.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    nodes = reps.join(asked, "node").select("node", "doc_id", "set_key", "sketch")
    sets = scratch.write(_full_sets(docs, nodes, shingle).dropDuplicates(["node"]), "sets")
    return spread(sig, reps, shared_ids, linked(multi, pairs, sets, percent, likely, scratch), scratch).drop("doc", "kept")
