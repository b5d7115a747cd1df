"""Benchmark decontamination: which short test items stand inside which documents.

Asymmetric MinHash: the least hash of an item's shingles lies in a document's set with a probability
that equals the item's containment. Items are partitioned by size; an item in the class of up to u
shingles is sketched by its floor((1 - t) * u) + 1 least hashes. At containment t or more at most
(1 - t) * u shingles are missing, so at least one sketched hash is in the document: the search finds
every such pair. Of candidates the document's shingles meet the item's as strings. Hashes move without
the text; the text is read once more where there is a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

SHINGLE = 5
WORD = r"[\p{L}\p{N}]+"
#: Up to this many sketched hashes, and shingles of this many characters, are broadcast; more are joined by shuffle.
BROADCAST_HASHES, BROADCAST_CHARS = 1_000_000, 50_000_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(words: str, n: int) -> Column:
    """All runs of n words, as strings; none if there are fewer words."""
    last = F.size(words) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def _gram_hashes(hashes: str, n: int) -> Column:
    """A 64-bit hash of each run of n words, from the words' hashes."""
    last = F.size(hashes) - n + 1
    arr = F.col(hashes)
    one = lambda i: F.xxhash64(*[F.get(arr, i + j) for j in range(n)])
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), one)
    ).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: str, widths: list[int], hashed: bool) -> Column:
    """Distinct shingles of all ``widths``: their hashes, or strings."""
    found = [_gram_hashes(words, n) if hashed else _grams(words, n) for n in widths]
    return F.array_distinct(F.concat(*found))


def item_sketches(items: DataFrame, threshold: float) -> DataFrame:
    """Per different item with words: a key, its shingles, their number, and the hashes that a search looks up.

    An item of fewer than five words has one shingle, the whole sequence.
    """
    sized = items.select("item_id", _words(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    sized = sized.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    width = F.least(F.size("words"), F.lit(SHINGLE))
    by_width = lambda f, c: F.coalesce(*[F.when(width == n, f(c, n)) for n in range(1, SHINGLE + 1)])
    sized = sized.select(
        "item_id",
        F.xxhash64("item_id", "words").alias("item"),
        width.alias("width"),
        F.array_distinct(by_width(_grams, "words")).alias("shingles"),
        F.array_sort(F.array_distinct(by_width(_gram_hashes, "hashes"))).alias("hashes"),
    )
    size_class = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("shingles"))))
    kept = F.floor(F.lit(1.0 - threshold) * size_class + F.lit(1e-9)).cast("int") + 1
    return sized.select(
        "item_id", "item", "width", "shingles", F.size("shingles").alias("n_shingles"), "hashes", F.slice("hashes", 1, kept).alias("sketch")
    )


def _keyed(docs: DataFrame, words: bool) -> DataFrame:
    """Id, a key of id and text, and the words or the text; equal rows have one key."""
    key = F.xxhash64("doc_id", "text").alias("doc")
    return docs.select("doc_id", key, _words(F.col("text")).alias("words") if words else "text")


def _pairs(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """doc_id, doc, item_id, n_shingles, n_shared, containment of the pairs at or above the threshold."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    sketches = scratch.write(item_sketches(items, threshold), "items")
    chars = F.sum(F.length(F.array_join("shingles", " ")).cast("long"))
    stats = sketches.agg(F.sum(F.size("sketch")).alias("n"), chars.alias("chars"), F.collect_set("width").alias("widths")).first()
    widths = sorted(stats["widths"]) or [SHINGLE]
    small = (stats["n"] or 0) <= BROADCAST_HASHES, (stats["chars"] or 0) <= BROADCAST_CHARS
    sent = lambda df, fits: F.broadcast(df) if fits else df

    hashed = _keyed(docs, True).select("doc_id", "doc", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    probes = hashed.select("doc_id", "doc", F.explode(_shingles("hashes", widths, True)).alias("h"))
    lookup = sketches.select(F.explode("sketch").alias("h"), "item")
    found = scratch.write(probes.join(sent(lookup, small[0]), "h").select("doc_id", "doc", "item").distinct(), "candidates")

    asked = found.select(F.col("doc_id").alias("d"), F.col("doc").alias("k")).distinct()
    texts = _keyed(docs, False).join(asked, (F.col("doc") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    words = texts.select("doc", _words(F.col("text")).alias("words"))
    grams = words.select("doc", F.explode(_shingles("words", widths, False)).alias("shingle"))
    if small[1]:  # what no item holds needn't move
        grams = grams.join(F.broadcast(sketches.select(F.explode("shingles").alias("shingle")).distinct()), "shingle", "left_semi")
    grams = grams.distinct()
    wanted = found.join(sent(sketches.select("item", "item_id", "n_shingles", "shingles"), small[1]), "item")
    wanted = wanted.select("doc_id", "doc", "item", "item_id", "n_shingles", F.explode("shingles").alias("shingle"))
    shared = wanted.join(grams, ["doc", "shingle"]).groupBy("doc_id", "doc", "item", "item_id", "n_shingles").agg(F.count("*").cast("int").alias("n_shared"))
    return shared.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= threshold)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The pairs of document and item with ``threshold`` or more of the item's shingles in the document.

    Needs ``doc_id, text`` and ``item_id, text``. A shingle is five consecutive words: letters and
    digits in lower case, whatever stands between. Returns ``doc_id, item_id, n_shingles, n_shared,
    containment``, a pair once however often it occurs; rows that share an id each count. Null and
    wordless texts are in no pair. Empty tables give an empty result.
    """
    best = F.max_by(F.struct("n_shingles", "n_shared", "containment"), F.struct("containment", "n_shingles")).alias("best")
    return _pairs(docs, items, threshold).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item; rows without a doc_id, too, are judged by their text."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    gone = scratch.write(_pairs(docs, items, threshold).select(F.col("doc_id").alias("__d"), F.col("doc").alias("__doc")).distinct(), "gone")
    same = (F.xxhash64(docs["doc_id"], docs["text"]) == F.col("__doc")) & docs["doc_id"].eqNullSafe(F.col("__d"))
    return docs.join(gone, same, "left_anti")
