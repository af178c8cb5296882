"""Quality score by naive Bayes support vectors.

A text is the set of its hashed n-grams: words, pairs of words, runs of three characters, and marks for
words that repeat. Each indicator is scaled by the log ratio of its smoothed shares in the two classes; a
linear hinge-loss model over the scaled indicators is fitted by dual coordinate descent, and margins
out of fold give the calibration to probabilities.

Cases: a null or empty text has no n-grams and gets the score of the calibrated bias; without labels of
both kinds the score is the share of label 1, or 0.5 without any label; one row of a label is enough to learn from;
repeated rows get equal scores, and a score that equals the threshold predicts 1; of texts that share an id the least teaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import linear
from millrace.llm.common import slices
from millrace.llm.textstats import WordHashes, char_grams, code_points, mixed, repeated_words, word_grams, words_of
from millrace.llm.training import PER_CLASS, Sample, featurised, fold_of, labelled

BITS = 16
DIMS = 1 << BITS
SMOOTHING = 1.0
COST = 1.0
FOLDS = 5
#: Places of the marks for repeated words: one for each tenth of the words that repeat.
REPEAT_MARKS = 11
#: Score from which `predicted` is 1.
THRESHOLD = 0.3


def grams_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The distinct feature ids of a text, in order."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64)
    h = hashes.of(words)
    seen = np.zeros(DIMS + REPEAT_MARKS, bool)
    seen[mixed(h, BITS, 11)] = True
    seen[mixed(word_grams(h, 2), BITS, 12)] = True
    seen[mixed(char_grams(code_points(text or ""), 3), BITS, 13)] = True
    if share := repeated_words(words) / len(words):
        seen[DIMS + min(int(share * 10), 10)] = True
    return np.flatnonzero(seen)


def sample_features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes = WordHashes()
    return [(grams_of(t, hashes), None) for t in texts]


@dataclass(frozen=True)
class ScoreModel:
    """`weights` already hold the log-count ratios."""

    weights: np.ndarray
    bias: float
    calibration: linear.Calibration

    def score(self, ids: np.ndarray) -> float:
        return float(self.calibration(self.weights[ids].sum() / np.sqrt(max(len(ids), 1)) + self.bias))


def log_ratios(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    size = DIMS + REPEAT_MARKS
    good, bad = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    for ids, t, w in zip(rows, target, weight, strict=True):
        (good if t else bad)[ids] += w
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def descend(rows: list[np.ndarray], target: np.ndarray, cost: np.ndarray, epochs: int = 25) -> tuple[np.ndarray, float]:
    """Dual coordinate descent on sparse rows: weights with the ratios folded in, and the bias."""
    ratio = log_ratios(rows, target, np.ones(len(rows)))
    values = [ratio[ids] / np.sqrt(max(len(ids), 1)) for ids in rows]
    norm = np.array([v @ v + 1.0 for v in values])
    sign = np.where(target > 0.5, 1.0, -1.0)
    w, bias, a = np.zeros(DIMS + REPEAT_MARKS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            ids, v = rows[i], values[i]
            new = min(max(a[i] - (sign[i] * (w[ids] @ v + bias) - 1.0) / norm[i], 0.0), cost[i])
            if (change := new - a[i]) != 0.0:
                a[i] = new
                w[ids] += change * sign[i] * v
                bias += change * sign[i]
                moved = max(moved, abs(change))
        if moved < 1e-4:
            break
    return (w * ratio).astype(np.float32), float(bias)


def fit(sample: Sample) -> ScoreModel:
    """The model of a sample with labels 0 and 1; a constant one where no row has one of them."""
    target = np.array([float(v == 1) for v in sample.label])
    if not 0 < target.sum() < len(target):
        share = float(sample.weight @ target / sample.weight.sum()) if len(target) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return ScoreModel(np.zeros(DIMS + REPEAT_MARKS, np.float32), 0.0, linear.Calibration(1.0, float(np.log(share / (1 - share)))))
    rows = [ids.astype(np.int64) for ids, _ in sample.rows]
    cost = COST * len(target) / 2 / np.where(target > 0.5, target.sum(), (1 - target).sum())
    fold, margin = linear.folds_of(target, FOLDS), np.zeros(len(target))
    for held in range(FOLDS):
        some, rest = np.flatnonzero(fold != held), np.flatnonzero(fold == held)
        w, bias = descend([rows[i] for i in some], target[some], cost[some])
        margin[rest] = [w[rows[i]].sum() / np.sqrt(max(len(rows[i]), 1)) + bias for i in rest]
    w, bias = descend(rows, target, cost)
    return ScoreModel(w, bias, linear.calibrate(margin, target, sample.weight))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, per_class: int = PER_CLASS) -> ScoreModel:
    return fit(featurised(*labelled(docs, labels, "quality", per_class, "quality-score", usable), sample_features))


def score(docs: DataFrame, model: ScoreModel, parts: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the score, the prediction, and whether the row's fold taught nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            found = [model.score(grams_of(t, hashes)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold_of("doc_id", parts) == held, F.lit(False)).alias("held_out"), "text")
    return given.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
