"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import held_out, labelled_sample

#: The fit reads at most this many labelled documents.
TRAINING_ROWS = 20_000
FOLDS, FOLD, CUT = 5, 0, 0.3
#: Part of a class covariance that the pooled one and its diagonal stand for.
POOLED, DIAGONAL, FLOOR = 0.1, 0.1, 1e-3
#: Shares of few lines or words say little; so many more are taken as fresh.
FEW = 5

FEATURES = (
    "log_words", "word_length", "upper", "digits", "stops", "marks", "pipes", "fresh", "repeats", "line_repeats",
    "marked_words", "shouted_words", "longest",
)

_UPPER, _DIGIT, _STOP = np.arange(65, 91), np.arange(48, 58), np.array([33, 44, 46, 58, 59, 63])
_MARK = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "!,.:;?|'\"()-"])


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text, in the order of ``FEATURES``; all 0 for null and blank texts."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, len(text))
    share = lambda codes: float(np.sqrt(raw[codes].sum() / size))
    lines = [x for x in text.split("\n") if x]
    fresh = len(set(words))
    return [
        np.log1p(n),
        np.log(sum(map(len, words)) / n),
        share(_UPPER),
        share(_DIGIT),
        share(_STOP),
        share(_MARK),
        float(np.sqrt(raw[124] / n)),
        np.log(fresh + FEW) / np.log(n + FEW),
        float(np.sqrt(sum(map(operator.eq, words, words[1:])) / (n + FEW))),
        (len(lines) - len(set(lines))) / (len(lines) + FEW),
        float(np.sqrt(sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\")" for w in words) / n)),
        float(np.sqrt(sum(map(str.isupper, words)) / n)),
        np.log1p(max(map(len, words))),
    ]


@dataclass
class Quadratic:
    """Per class, 0 then 1: mean, inverse Cholesky factor of the covariance, log of its determinant's root, log prior."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverse: list[np.ndarray]
    log_root: list[float]
    log_prior: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [
            p - r - 0.5 * np.square((z - m) @ i.T).sum(axis=1)
            for m, i, r, p in zip(self.means, self.inverse, self.log_root, self.log_prior)
        ]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -50, 50)))


def fit(x: np.ndarray, y: np.ndarray) -> Quadratic:
    """Fit the discriminant. A class with no rows gets the pooled moments, so scores are then the smoothed prior."""
    d = len(FEATURES)
    x = x.reshape(-1, d)
    centre, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(d), np.ones(d))
    z = (x - centre) / scale
    pooled = z.T @ z / max(1, len(z)) + FLOOR * np.eye(d)
    means, inverse, roots, priors = [], [], [], []
    for label in (0, 1):
        own = z[y == label]
        mean = own.mean(axis=0) if len(own) else np.zeros(d)
        trust = len(own) / (len(own) + d)
        cov = trust * (own - mean).T @ (own - mean) / max(1, len(own)) + (1 - trust) * pooled
        cov = (1 - POOLED - DIAGONAL) * cov + POOLED * pooled + DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        inverse.append(np.linalg.inv(factor))
        roots.append(float(np.log(np.diag(factor)).sum()))
        priors.append(float(np.log((len(own) + 1) / (len(z) + 2))))
    return Quadratic(centre, scale, means, inverse, roots, priors)


def _features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))],
                names=["doc_id", "label", "x"],
            )

    rows = sample.mapInArrow(run, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label int, x array<double>")
    got = rows.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("r.x", "r.label").toArrow()
    return np.array(got.column("x").to_pylist(), float), np.array(got.column("label").to_pylist(), int)


def score_quality(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """Score every text; learns ``labels.quality`` outside the held-out fold.

    Needs ``doc_id, text`` and ``doc_id, quality``. Returns one row per input row: ``doc_id, held_out,
    score, predicted``. The model is a few small matrices; its fit reads ``training_rows`` labelled
    documents at most, those of least hash, each doc_id once. Null and empty texts are scored as a
    text of no words. Without labels every score is 0.5.
    """
    model = fit(*_features(labelled_sample(docs, labels, "quality", FOLDS, FOLD, training_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(np.array([statistics(t.as_py()) for t in batch.column("text")]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score)], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
