"""Toxicity from a weighted lexicon, matched by Aho-Corasick over folded text.

Folding undoes homoglyphs and digit substitutions. A hit counts with its entry's weight unless an
exception phrase covers it. Weights are log-odds learned from labelled texts, beside a list of known
insults; the length-normalised sums become a score by a logistic fit.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .training import held_out, labelled_sample

#: The fit reads at most this many labelled documents; the lexicon keeps every entry that they support.
TRAINING_ROWS = 20_000
FOLDS, FOLD, CUT = 4, 2, 0.3
#: An entry is learned from this many different contexts in toxic texts, this many times as frequent there.
CONTEXTS, ODDS = 4, 12.0

# Look-alike letters of other scripts, then digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "п": "n", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
# Known insults.
INSULTS = (
    "asshole", "bastard", "bitch", "clown", "crap", "cretin", "cunt", "degenerate", "dickhead", "disgusting", "dumbass",
    "fool", "fuck", "fucker", "fucking", "idiot", "idiotic", "imbecile", "jerk", "loser", "lowlife", "moron", "moronic",
    "pathetic", "scum", "scumbag", "shit", "shithead", "stupid", "trash", "twat", "vermin", "wanker", "worthless",
)
# Phrases in which such words insult nobody.
EXCEPTIONS = (
    "clown car", "clown fish", "circus clown", "foolproof", "fool proof", "idiot proof", "trash bag", "trash bin",
    "trash can", "take out the trash", "worthless check", "jerk chicken", "stupid question",
)
INSULT_WEIGHT = 4.0

_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {chr(0xFEE0 + ord(c)): c for c in "abcdefghijklmnopqrstuvwxyz"})
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Words in lower case between single spaces, with look-alikes and digits as the letters they stand for."""
    return f" {_GAP.sub(' ', (text or '').lower().translate(_FOLD)).strip()} "


class Lexicon:
    """Aho-Corasick automaton of entries and exception phrases, each between spaces."""

    def __init__(self, weights: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        for phrase, weight in [*weights.items(), *((p, 0.0) for p in EXCEPTIONS)]:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, weight))
        self.automaton.make_automaton()

    def sums(self, text: str | None) -> tuple[float, float]:
        """Log of the weights' sum, and of the sum for a thousand words; 0 without hits."""
        folded, hits, safe = fold(text), [], []
        for end, (size, weight) in self.automaton.iter(folded):
            (hits if weight else safe).append((end - size + 1, end, weight))
        if safe:
            starts = sorted(s for s, _, _ in safe)
            ends = list(accumulate((e for _, e, _ in sorted(safe)), max))  # of the exceptions that start no later, the last end
            hits = [h for h in hits if not (n := bisect_right(starts, h[0])) or ends[n - 1] < h[1]]
        total = sum(w for _, _, w in hits)
        return float(np.log1p(total)), float(np.log1p(1000 * total / max(1, folded.count(" ") - 1)))


def _learned(sample: DataFrame) -> dict[str, float]:
    """Log-odds of all words that stand in enough different contexts of toxic texts.

    Contexts are counted, not texts: a word that only the copies of one text have says little. The
    number of entries is bounded by the sample alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                found: Counter = Counter()
                part = batch.slice(start, 200)
                for text, label in zip(part.column("text"), part.column("label")):
                    words = fold(text.as_py()).split()
                    found.update({(w, b, label.as_py()) for b, w in zip(["", *words], words)})
                keys = list(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))],
                    names=["word", "before", "label"],
                )

    seen = sample.mapInArrow(run, "word string, before string, label int").filter(F.length("word") >= 3).distinct()
    counts = seen.groupBy("word").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    counts = counts.filter(F.col("bad") >= CONTEXTS)
    parts = sample.groupBy("label").agg(F.sum(F.length("text")).alias("n")).collect()
    sizes = {r["label"]: r["n"] or 1 for r in parts}
    odds = (F.col("bad") / (F.col("good") + 0.5)) * (sizes.get(0, 1) / sizes.get(1, 1))
    top = counts.withColumn("odds", odds).filter(F.col("odds") >= ODDS).select("word", "odds").toArrow()
    return dict(sorted(zip(top.column("word").to_pylist(), np.log(top.column("odds").to_numpy()).tolist())))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ridge logistic regression of rows that stand for ``n`` by Newton steps; intercept first. Without both labels, a fixed rule."""
    if len(set(y.tolist())) < 2:
        return np.array([-4.0, 1.0, 1.0])
    a = np.c_[np.ones(len(x)), x]
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-3, 0.05, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve(a.T * (n * p * (1 - p)) @ a + ridge, a.T @ (n * (y - p)) - ridge @ w)
    return w


SUMS = "label int, total double, rate double"


@dataclass
class Toxicity:
    """A lexicon and the logistic weights of its sums."""

    lexicon: Lexicon
    weights: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        sums = np.array([self.lexicon.sums(t.as_py()) for t in texts]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + sums @ self.weights[1:], -50, 50)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, known: tuple[str, ...] = INSULTS) -> Toxicity:
    """Learn from ``training_rows`` labelled ids at most, those of least hash. Their texts are written once and read by both passes."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.write(labelled_sample(docs, labels, "toxic", FOLDS, FOLD, training_rows), "sample")
    lexicon = Lexicon(dict.fromkeys(known, INSULT_WEIGHT) | _learned(sample))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = np.array([lexicon.sums(t.as_py()) for t in batch.column("text")])
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["label", "total", "rate"])

    # Equal sums are one row with a count, so copies of a text don't grow what reaches the driver.
    sums = sample.select("label", "text").mapInArrow(summed, SUMS).groupBy("label", "total", "rate").agg(F.count("*").alias("n"))
    got = [np.array(c.to_pylist(), float) for c in sums.orderBy("label", "total", "rate").toArrow().columns]
    scratch.drop("sample")
    return Toxicity(lexicon, logistic(np.c_[got[1], got[2]], got[0], got[3]))


def score_toxicity(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, known: tuple[str, ...] = INSULTS) -> DataFrame:
    """Score every text; learns ``labels.toxic`` outside the held-out fold.

    Needs ``doc_id, text`` and ``doc_id, toxic``. Returns one row per input row: ``doc_id, held_out,
    score, predicted``. Null and empty texts have no hits. Without labels the known insults alone decide.
    """
    model = fit_toxicity(docs, labels, training_rows, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = pa.array(model.score(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], score], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't scored as toxic, in one pass without a shuffle."""
    model = fit_toxicity(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.score(batch.column("text")) < CUT))

    return docs.mapInArrow(run, docs.schema)
