"""Document fingerprints from closed syncmers.

The units of a text are its words in pieces of three characters. Of the k-mers of units
those are anchors whose least s-mer stands at an edge. Whether a k-mer is an anchor depends on
nothing outside it, so texts that share a passage share the anchors inside. A fingerprint holds all
different anchors of a text, each with its first position. Two texts are matched by position: a
shared anchor counts if another one stands about as far from its place in the other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import let

UNIT = r"[^\x20\x09-\x0D]{1,3}"
K, S = 5, 2
#: Shared anchors confirm each other if the distances of their places in the two texts differ by so many units at most.
DRIFT = 8
#: Ids that share all but so many low bits are put in order in one group, level by level.
ID_BITS = 16

_SIDE, _PLACE = 1 << 31, (1 << 31) - 1


def _codes(text: Column, k: int = K, s: int = S) -> Column:
    """A text's anchors by position: 31 bits of the hash, then 32 bits of the position."""
    n = k - s + 1  # s-mers in a k-mer
    code = lambda hashed, i: F.shiftleft(F.shiftrightunsigned(hashed, 33), 32).bitwiseOR(i.cast("bigint"))
    whole = lambda u: F.array(code(F.xxhash64(F.lit(k), u), F.lit(0)))

    def chosen(u: Column) -> Column:
        smers = F.transform(u, lambda x, i: F.xxhash64(x, *[F.get(u, i + j) for j in range(1, s)]))
        spread = [*range(0, k - s, s), k - s]  # s-mers that cover the k-mer

        def picked(m: Column, last: Column) -> Column:
            edge = lambda x, i: F.least(x, F.get(m, i + n - 1)) <= F.array_min(F.array(*[F.get(m, i + j) for j in range(1, n - 1)]))
            hashed = lambda x, i: F.xxhash64(x, *[F.get(m, i + j) for j in spread[1:]])
            return F.transform(m, lambda x, i: F.when((i <= last) & edge(x, i), code(hashed(x, i), i)))

        found = let(smers, lambda m: let(F.size(m) - k, lambda last: F.filter(picked(m, last), lambda x: x.isNotNull())))
        return let(found, lambda c: F.when(F.size(c) > 0, c).otherwise(whole(u)))

    units = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))
    none = F.array().cast("array<bigint>")
    return let(units, lambda u: F.when(F.size(u) >= k, chosen(u)).when(F.size(u) > 0, whole(u)).otherwise(none))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (position, hash) of a text's closed syncmers; position counts units from 0.

    A text with units but without a closed syncmer, such as one of fewer than k units, has one anchor,
    all of it; one without units has none.
    """
    one = lambda x: F.struct(x.bitwiseAND(F.lit(_PLACE)).cast("int").alias("position"), F.shiftright(x, 32).alias("hash"))
    return F.transform(_codes(text, k, s), one)


def places(text: Column) -> Column:
    """The different anchors of a text in order of their hashes: 31 bits of the hash, then 32 bits of its first position."""
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x.bitwiseXOR(F.get(s, i - 1)), 32) != 0))
    return let(F.sort_array(_codes(text)), first)


def printed(place_array: Column) -> Column:
    """The hashes of a text's places as text, eight hex digits each."""
    return F.lower(F.array_join(F.transform(place_array, lambda x: F.left(F.lpad(F.hex(x), 16, "0"), F.lit(8))), ""))


def likeness(a: Column, b: Column, drift: int = DRIFT) -> Column:
    """Share of anchors that two texts' places have in common, matched by position; two empty texts are alike.

    Where a text has one anchor alone, there is none to confirm it and the hash decides.
    """
    other = F.transform(b, lambda x: x.bitwiseOR(F.lit(_SIDE)))  # sorts after the same hash of the first text
    place = lambda x: x.bitwiseAND(F.lit(_PLACE))
    apart = lambda x, before: F.when(F.shiftright(x.bitwiseXOR(before), 32) == 0, place(x) - place(before))
    pairs = let(F.sort_array(F.concat(a, other)), lambda s: F.transform(s, lambda x, i: apart(x, F.get(s, i - 1))))
    confirmed = lambda f: F.size(F.filter(f, lambda x, i: (x - F.get(f, i - 1) <= drift) | (F.get(f, i + 1) - x <= drift)))
    shared = lambda f: F.when(F.least(F.size(a), F.size(b)) == 1, F.size(f)).otherwise(confirmed(f))
    total = F.size(a) + F.size(b)
    share = let(let(F.sort_array(F.filter(pairs, lambda x: x.isNotNull())), shared), lambda n: n / F.greatest(total - n, F.lit(1)))
    return F.when(total == 0, F.lit(1.0)).otherwise(share)


def fingerprint(docs: DataFrame) -> DataFrame:
    """Add ``anchors`` and ``places`` of ``text`` to the columns of ``docs``, replacing columns of these names."""
    return docs.withColumn("anchors", anchors(F.col("text"))).withColumn("places", places(F.col("text")))


def next_ids(ids: DataFrame, column: str) -> DataFrame:
    """Each different id in ``column`` with the next one (``next_id``) in ascending order; after the last comes the first.

    Ids are put in order inside groups that share their high bits; what comes after a group is found
    from the groups' least ids, the same way. So no group has over 2**16 ids, whatever their number.
    """
    level = ids.filter(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("id")).distinct()
    levels = [level]
    for _ in range(3):
        level = level.select(F.shiftright("id", ID_BITS).alias("id")).distinct()
        levels.append(level)
    lead = Window.orderBy("id")  # the topmost level has at most 2**16 ids in all
    whole = lead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = levels[3].select("id", F.coalesce(F.lead("id").over(lead), F.first("id").over(whole)).alias("next_id"))
    for below in reversed(levels[:3]):
        group = F.shiftright("id", ID_BITS).alias("g")
        least = below.groupBy(group).agg(F.min("id").alias("least"))
        after = known.select(F.col("id").alias("g"), F.col("next_id").alias("n")).join(
            least.select(F.col("g").alias("n"), "least"), "n"
        )
        w = Window.partitionBy("g").orderBy("id")
        inside = below.select("id", group).withColumn("inner", F.lead("id").over(w))
        last = inside.join(after.select("g", "least"), "g")
        known = last.select("id", F.coalesce("inner", "least").alias("next_id"))
    return known.select(F.col("id").alias(column), "next_id")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint each text, the same text with its last quarter edited, and the next document's.

    Needs ``doc_id`` and ``text`` (null: empty). The edit replaces the last floor(n / 4) code points
    by the first as many of the next document, ascending doc_id; after the last comes the first, and
    of rows that share a doc_id the one with the least text is the next document. Rows without a
    doc_id have themselves as the next document. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. Every text moves twice, to its own id and to the document
    before it, where its anchors are made again: moving them, too, would cost more than that.
    """
    if dict(docs.dtypes)["doc_id"] != "bigint":  # a cast that does nothing would keep the two shuffles apart
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Both joins below read the same shuffle of these rows; so sketches are made after it.
    base = rows.filter(F.col("doc_id").isNotNull())
    wanted = next_ids(docs, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"))
    heads = base.join(wanted, "doc_id").select(F.col("before").alias("doc_id"), "text").groupBy("doc_id").agg(F.min("text").alias("next"))
    both = base.join(heads, "doc_id").unionByName(rows.filter(F.col("doc_id").isNull()).withColumn("next", F.col("text")))
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.left("text", F.length("text") - quarter), F.left("next", quarter))
    out = both.select("doc_id", "text", "next", edited.alias("edited"))
    out = out.withColumns({"places": places(F.col("text")), "edited_places": places(F.col("edited")), "next_places": places(F.col("next"))})
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("places")).alias("fingerprint"),
        printed(F.col("edited_places")).alias("edited_fingerprint"),
        likeness(F.col("places"), F.col("edited_places")).alias("near_edited"),
        likeness(F.col("places"), F.col("next_places")).alias("near_next"),
    )
