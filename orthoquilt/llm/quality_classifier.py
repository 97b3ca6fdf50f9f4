"""Quality classifier (operator 10): regularised quadratic discriminant over document statistics.

A text becomes a short vector of statistics, each transformed so that it is roughly normal within a
class. Class means and covariances come from sums over all labelled rows, added up where the rows are;
the covariances are shrunk to their diagonal and to the pooled one. The difference of the two log densities, whose
Mahalanobis terms use Cholesky factors computed once, becomes a chance of label 1 by a logistic curve that is fitted
to the histogram of the differences of all labelled rows (classes are not exactly normal, so the plain posterior is too sure).

Null and empty texts have the statistics of no words and are scored like any other; very long texts are
taken whole; repeated rows get a row each; labels that repeat for an id count once (the highest), null labels not at all;
an empty table gives no rows; if a label is missing altogether every score is the share of label 1 (0.5 without
labels); extra columns are ignored. Equal texts have equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoquilt.llm.common import bounded_or_shuffled, fold, small_batches, stored, table

#: Weight of the diagonal in a class's covariance, then of the pooled covariance, and the least variance.
TO_DIAGONAL, TO_POOLED, RIDGE = 0.1, 0.05, 0.02
LIMIT = 0.3
FEATURES = (
    "words", "word_length", "distinct", "upper", "symbols", "marks", "bars", "stops", "digits", "repeated", "doubled", "equal_lines", "top_word",
)
_TINY = 0.002
#: For the curve (not for scores) differences are counted in whole numbers up to here, either way; larger ones count here.
FARTHEST = 500


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text."""
    text = text or ""
    words = text.split()
    n = len(words)
    seen = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    chars = max(1, int(seen.sum()))
    letters = max(1, int(seen[65:91].sum() + seen[97:123].sum()))
    share = lambda of, k: math.log(_TINY + k / of)
    counts = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 0
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n),
        math.log1p(chars / max(1, n)),
        math.log(max(1, n) / max(1, len(counts))) / (1 + math.log1p(n)),
        share(letters, int(seen[65:91].sum())),
        share(chars, int(seen[[35, 36, 37, 38, 42]].sum())),
        share(chars, int(seen[33] + seen[63])),
        share(chars, int(seen[[60, 62, 124]].sum())),
        share(max(1, n), int(seen[44] + seen[46])),
        share(chars, int(seen[48:58].sum())),
        share(1, 1 - triples / (n - 2) if n > 2 else 0.0),
        share(max(1, n), sum(map(str.__eq__, words, words[1:]))),
        share(1, 1 - len(set(lines)) / len(lines) if lines else 0.0),
        share(max(1, n), max(counts.values(), default=0)),
    ]


def with_statistics(df: DataFrame) -> DataFrame:
    """doc_id and x, the vector of statistics, of df's doc_id and text."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "x"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    """Of each label: mean, inverse of the Cholesky factor, log determinant and log share; slope and shift of the curve."""

    classes: list[tuple[np.ndarray, np.ndarray, float, float]]
    share: float
    slope: float = 1.0
    shift: float = 0.0

    def differences(self, x: np.ndarray) -> np.ndarray:
        bad, good = ((((x - m) @ inverse.T) ** 2).sum(1) * -0.5 - det / 2 + prior for m, inverse, det, prior in self.classes)
        return good - bad

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(x) + self.shift, -700, 700)))


def curve(at: np.ndarray, n0: np.ndarray, n1: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the counts of labels 0 and 1 at each difference, by damped
    Newton steps; targets are drawn in by a row of each label (as for calibrated margins), so separable rows have a fit too."""
    high, low = (n1.sum() + 1) / (n1.sum() + 2), 1 / (n0.sum() + 2)
    scale = max(1.0, float(np.abs(at).max()))
    z, n, hits = at / scale, n0 + n1, n1 * high + n0 * low
    w = np.array([0.0, math.log(high / low)])
    loss = lambda w: float((n * np.logaddexp(0, w[0] * z + w[1]) - hits * (w[0] * z + w[1])).sum()) + 1e-6 * float(w @ w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -700, 700)))
        g = np.array([((n * p - hits) * z).sum(), (n * p - hits).sum()]) + 2e-6 * w
        v = n * p * (1 - p)
        step = np.linalg.solve(np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]]), g)
        now, t = loss(w), 1.0
        while t > 1e-6 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def model_of(n: dict[int, float], sums: dict[int, np.ndarray], squares: dict[int, np.ndarray]) -> Model:
    """From each label's number of rows, sums of the statistics and sums of their products."""
    total = sum(n.values())
    if not n.get(0) or not n.get(1):
        return Model([], n.get(1, 0) / total if total else 0.5)
    mean = {k: sums[k] / n[k] for k in (0, 1)}
    cov = {k: squares[k] / n[k] - np.outer(mean[k], mean[k]) for k in (0, 1)}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
    scale = np.diag(np.diag(pooled) + 1e-6)
    classes = []
    for k in (0, 1):
        own = (1 - TO_DIAGONAL) * cov[k] + TO_DIAGONAL * np.diag(np.diag(cov[k]))
        own = (1 - TO_POOLED) * own + TO_POOLED * pooled + RIDGE * scale
        factor = np.linalg.cholesky(own)
        classes.append((mean[k], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()), math.log(n[k] / total)))
    return Model(classes, n[1] / total)


def learned(stats: DataFrame, labels: DataFrame) -> Model:
    """The model of stats (doc_id, x) and labels (doc_id, quality)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    size = len(FEATURES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(1 + size + size * size) for k in (0, 1)}
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, size)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for k, t in total.items():
                own = x[y == k]
                t += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([total[0].tolist(), total[1].tolist()], pa.list_(pa.float64()))], ["k", "v"])

    rows = stored(stats.join(bounded_or_shuffled(known), "doc_id").select("x", "quality"), "labelled")
    parts = rows.mapInArrow(add, "k int, v array<double>")
    sums = parts.select("k", F.posexplode("v").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect()  # two vectors
    found = {k: np.zeros(1 + size + size * size) for k in (0, 1)}
    for k, i, v in sums:
        found[k][i] = v
    model = model_of(
        {k: v[0] for k, v in found.items()}, {k: v[1 : 1 + size] for k, v in found.items()}, {k: v[1 + size :].reshape(size, size) for k, v in found.items()}
    )
    if not model.classes:
        return model

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(model.differences(x), -FARTHEST, FARTHEST)).astype(np.int32)), batch.column(1)], ["at", "quality"])

    counts = rows.mapInArrow(place, "at int, quality int").groupBy("at", "quality").count().collect()  # at most 4 * FARTHEST + 2 rows
    n = np.zeros((2, 2 * FARTHEST + 1))
    for at, k, c in counts:
        if k in (0, 1):
            n[k, at + FARTHEST] = c
    model.slope, model.shift = curve(np.arange(-FARTHEST, FARTHEST + 1.0), n[0], n[1])
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of stats (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text of `documents`; labels of the held-out fifth are not used."""
    stats = stored(with_statistics(table(spark, sf_dir, "documents")), "statistics")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held)
    found = scored(stats, learned(stats, labels))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
