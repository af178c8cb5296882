"""Quality rules: counts over whole texts, and a calibrated logistic regression on hashed n-grams
(runs of one to three words, and of two and three characters).

The regression is fitted on a sample of the labelled rows (`per_class` of each label), its margins out of
fold give a Platt calibration, and every document is scored in Arrow batches against fixed thresholds.

Cases: a null or empty text has no words and fails the base rule; without labels of both kinds there is
nothing to learn and the base rule alone decides; one row of a label is enough to learn from; repeated rows get
equal results, and a probability that equals the threshold is kept; of texts that share an id the least teaches; columns that the
operator does not use pass through `keep_documents` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import linear
from millrace.llm.common import slices
from millrace.llm.textstats import WordHashes, base_counts, char_grams, code_points, mixed, word_grams, words_of
from millrace.llm.training import PER_CLASS, Sample, featurised, labelled

WORD_BITS = CHAR_BITS = 12
#: Words in a run that is a feature.
WORD_ORDERS = (1, 2, 3)
DIMS = (1 << WORD_BITS) + (1 << CHAR_BITS)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document is kept when its probability of good quality reaches this.
LEAST_PROBABILITY = 0.35
L2 = 0.02
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, probability double"


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    calibration: linear.Calibration

    def probability(self, features: np.ndarray) -> float:
        return float(self.calibration(features @ self.weights + self.bias))


def block(grams: np.ndarray, bits: int, salt: int) -> np.ndarray:
    """Square roots of the shares of each hashed n-gram: a vector of length one, or zeros."""
    return np.sqrt(np.bincount(mixed(grams, bits, salt), minlength=1 << bits) / max(len(grams), 1)).astype(np.float32)


def features_of(text: str | None, words: list[bytes], hashes: WordHashes) -> np.ndarray:
    chars = np.concatenate([char_grams(code_points(text or ""), order) for order in (2, 3)])
    single = hashes.of(words)
    runs = np.concatenate([word_grams(single, order) for order in WORD_ORDERS])
    return np.concatenate([block(runs, WORD_BITS, 1), block(chars, CHAR_BITS, 2)])


def sample_features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes, out = WordHashes(), []
    for text in texts:
        x = features_of(text, words_of(text), hashes)
        ids = np.flatnonzero(x)
        out.append((ids, x[ids]))
    return out


def fit(sample: Sample) -> QualityModel | None:
    """The model of a sample with labels 0 and 1, or None if no row has one of them. A label of one row is enough."""
    target = np.array([float(v == 1) for v in sample.label])
    if not 0 < target.sum() < len(target):
        return None
    x = sample.dense(DIMS)
    k = linear.gram(x)
    solve = lambda rows: linear.logistic_dual(k[np.ix_(rows, rows)], target[rows], np.ones(len(rows)), L2)
    margin = linear.out_of_fold(k, linear.folds_of(target, 5), solve)
    alpha = solve(np.arange(len(target)))
    return QualityModel((alpha @ x).astype(np.float32), float(alpha.sum()), linear.calibrate(margin, target, sample.weight))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel | None:
    return fit(featurised(*labelled(docs, labels, "quality", per_class, "quality-rules"), sample_features))


def verdict(text: str | None, hashes: WordHashes, model: QualityModel | None, least: float) -> tuple:
    """The counts of a text, base_failed, kept and the probability (null when the base rule decided)."""
    words = words_of(text)
    counts = base_counts(text, words)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
    probability = None if failed or model is None else model.probability(features_of(text, words, hashes))
    return *counts, failed, not failed and (probability is None or probability >= least), probability


def apply_rules(docs: DataFrame, model: QualityModel | None, least: float = LEAST_PROBABILITY) -> DataFrame:
    """One row per document: the counts, the verdict and the probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
        for batch in slices(batches):
            rows = [verdict(t, hashes, model, least) for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, SCHEMA)


def keep_documents(docs: DataFrame, model: QualityModel | None, least: float = LEAST_PROBABILITY) -> DataFrame:
    """The documents that the rules keep, with all their columns, in one pass without a shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            yield batch.filter(pa.array([verdict(t, hashes, model, least)[6] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
