"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a long run of one character class. Its windows' Shannon entropy is kept up by counts:
a window's sum of c * log2(c) changes only at the character that enters and the one that leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let, running

# Kind, pattern, group that is measured, least length of that group.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

WINDOW = 24
#: Texts are masked piece by piece, of so many code points.
PIECE = 4096
#: Class, pattern of a candidate, bits per character from which a window is suspicious.
CLASSES = (
    ("entropy_hex", r"\b[0-9A-Fa-f]{24,}\b", 3.0),
    ("entropy_base64", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9A-Z+/_=-]*[a-z])(?=[0-9a-z+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{24,}", 4.0),
    ("entropy_lower", r"(?<![A-Za-z0-9])(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]{24,}+(?![A-Za-z0-9])", 3.8),
    ("entropy_upper", r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{24,}+(?![A-Za-z0-9])", 3.75),
    ("entropy_letters", r"(?<![A-Za-z0-9+/_=-])(?=[A-Z+/_=-]*[a-z])(?=[a-z+/_=-]*[A-Z])[A-Za-z+/_=-]{24,}+(?![A-Za-z0-9+/_=-])", 4.2),
)
#: Windows with one of these aren't measured.
PLACEHOLDER = r"(?i)(?:example|placeholder|changeme|dummy|xxxxxx|000000)"
#: Candidates that are never secrets.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]+$",
    r"(?i)^(sha(256|384|512)-)",
    r"^[A-Za-z]+([/_-][A-Za-z]+)+$",
)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, found), code points, end exclusive."""

    def placed(hits: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        sizes = F.zip_with(pieces, hits, lambda piece, hit: F.length(piece) + F.length(hit))
        span = lambda ends, hit, i: F.struct((F.get(ends, i) - F.length(hit)).alias("start"), F.get(ends, i).alias("end"), hit.alias("found"))
        return let(let(sizes, lambda n: running(n, lambda x, y: x + y)), lambda ends: F.transform(hits, lambda hit, i: span(ends, hit, i)))

    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def most_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits per character, of the windows of a candidate (of ASCII characters).

    The window's counts of all characters are carried along. What leaves and what enters it changes one
    count each, and so one term of the sum of c * log2(c).
    """

    def events(codes: Column) -> Column:
        coming = lambda i: F.struct(F.get(codes, i).alias("code"), F.lit(1).alias("by"), i.alias("at"))
        going = lambda i: F.struct(F.get(codes, i - window).alias("code"), F.lit(-1).alias("by"), i.alias("at"))
        order = F.sequence(F.lit(0), F.size(codes) - 1)
        return F.flatten(F.transform(order, lambda i: F.when(i >= window, F.array(going(i), coming(i))).otherwise(F.array(coming(i)))))

    def step(acc: Column, e: Column) -> Column:
        before = F.get(acc["counts"], e["code"])
        total = acc["sum"] + _clog(before + e["by"]) - _clog(before)
        counts = F.concat(F.slice(acc["counts"], 1, e["code"]), F.array(before + e["by"]), F.slice(acc["counts"], e["code"] + 2, 128))
        full = (e["at"] >= window - 1) & (e["by"] > 0)
        most = F.when(full, F.greatest(acc["most"], math.log2(window) - total / window)).otherwise(acc["most"])
        return F.struct(counts.alias("counts"), total.alias("sum"), most.alias("most"))

    zero = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("most"))
    codes = F.transform(F.slice(F.split(candidate, ""), 1, F.length(candidate)), lambda c: F.ascii(c))
    return F.aggregate(let(codes, events), zero, step, lambda acc: acc["most"])


def _tagged(spans: Column, kind: str, order: int, found: bool = False) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), *[s["found"].alias("found")] * found
        ),
    )


def find_secrets(docs: DataFrame, name: str = "secrets") -> DataFrame:
    """Find secrets in every ``text``.

    Adds a column ``name`` to those of ``docs``, replacing one of this name: an array of (start, rank,
    end, kind), sorted; code points, end exclusive. Kinds: ``assign``, ``access``, ``hex`` and, by
    entropy, those of ``CLASSES`` where none of these three covers the candidate. Null and
    empty texts have none. Work and memory follow a text's length and, by a logarithm more, its finds.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda s: F.regexp_extract(s["found"], ASSIGN, 2)
    base = F.concat(
        _tagged(F.filter(matches(text, ASSIGN), lambda s: F.length(value(s)) >= 6), "assign", 0, True),
        _tagged(matches(text, ACCESS), "access", 1, True),
        _tagged(matches(text, HEX), "hex", 2, True),
    )
    candidates = F.concat(*[_tagged(matches(text, pattern), kind, rank, True) for rank, (kind, pattern, _) in enumerate(CLASSES, 3)])
    least = F.array(*[F.lit(x) for _, _, x in CLASSES])

    def suspicious(spans: Column) -> Column:
        """In order of starts, base spans first: a candidate that no base span before it reaches around, and that measures."""
        reach = let(F.transform(spans, lambda s: F.when(s["rank"] < 3, s["end"]).otherwise(F.lit(0))), lambda e: running(e, F.greatest))
        free = let(reach, lambda r: F.filter(spans, lambda s, i: (s["rank"] < 3) | (F.get(r, i) < s["end"])))
        return F.filter(free, lambda s: (s["rank"] < 3) | (_none_of(s["found"]) & _measures(s["found"], F.get(least, s["rank"] - 3))))

    found = docs.withColumn("__secret_spans", F.concat(base, candidates))
    spans = F.when(F.size("__secret_spans") > 0, let(F.array_sort("__secret_spans"), suspicious)).otherwise(F.col("__secret_spans"))
    plain = lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind")])
    return found.withColumn(name, F.transform(spans, plain)).drop("__secret_spans")


def _none_of(found: Column) -> Column:
    out = F.lit(True)
    for pattern in ALLOW:
        out = out & ~F.regexp_like(found, F.lit(pattern))
    return out


def _measures(found: Column, least: Column) -> Column:
    """Whether a window without a placeholder reaches ``least``; pieces shorter than a window have none."""
    pieces = F.filter(F.split(found, PLACEHOLDER, -1), lambda piece: F.length(piece) >= WINDOW)
    return F.exists(pieces, lambda piece: most_entropy(piece) >= least)


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mask``; all rows and columns stay.

    Overlapping spans are masked as one. Null texts stay null. ``n_chars``, if there is such a
    column, is set to the new length.
    """
    found = find_secrets(docs, "__secrets").withColumn("__pieces", F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)))
    spans, pieces = F.col("__secrets"), F.col("__pieces")

    def cut(start: Column, end: Column) -> Column:
        """Code points start to end; reads the pieces that they lie in."""
        first = F.floor(start / PIECE).cast("int")
        here = F.array_join(F.slice(pieces, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(here, start - first * PIECE + 1, end - start)).otherwise(F.lit(""))

    def masked(reach: Column) -> Column:
        """``reach``: how far each span and those before it go. Spans that start before that are in one mask."""
        starts = F.filter(spans, lambda s, i: (i == 0) | (s["start"] >= F.get(reach, i - 1)))
        ends = F.filter(reach, lambda e, i: (i == F.size(reach) - 1) | (F.get(spans, i + 1)["start"] >= e))
        kept = lambda ends: F.transform(starts, lambda s, i: F.concat(cut(F.coalesce(F.get(ends, i - 1), F.lit(0)), s["start"]), F.lit(mask)))
        rest = cut(F.get(reach, F.size(reach) - 1), F.length("text"))
        return F.concat(F.array_join(let(ends, kept), ""), rest)

    reach = let(F.transform(spans, lambda s: s["end"]), lambda e: running(e, F.greatest))
    text = F.when(F.size("__secrets") > 0, let(reach, masked)).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)
