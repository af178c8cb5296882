"""Language identification in two steps: the family, then the language within it.

Texts are represented by the square roots of the shares of their hashed character runs (one to three
letters, in lower case). A linear support vector machine for each pair of families votes on the family;
within it, one for each pair of languages, fitted on that pair alone, votes on the language. Margins become
probabilities by calibration on rows that the machine did not see. Everything is learned from a
sample of the given rows, `per_class` of each language.

Cases: a null text, or one without a letter, is `und` with score 0; with no language to learn from every
text is `und`; with one, every text with a letter is that one, with score 1; equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import linear
from millrace.llm.common import class_sample, slices
from millrace.llm.textstats import char_grams, code_points, has_letter, mixed
from millrace.llm.training import Sample, featurised, fold_of

#: Language families by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "indic": ("hi", "bn", "ur", "pa", "gu", "mr", "ne"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "am", "mt"),
}
UNKNOWN = "und"
BITS = 12
ORDERS = (1, 2, 3)
DIMS = len(ORDERS) << BITS
PER_LANGUAGE = 500
COST = 4.0


def family_of(language: str) -> str:
    return next((name for name, codes in FAMILIES.items() if language.split("-")[0].lower() in codes), language)


def features_of(text: str) -> np.ndarray:
    points = code_points(text.lower())
    parts = []
    for order in ORDERS:
        grams = char_grams(points, order)
        parts.append(np.sqrt(np.bincount(mixed(grams, BITS, order), minlength=1 << BITS) / max(len(grams), 1)))
    return np.concatenate(parts).astype(np.float32)


def sample_features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for text in texts:
        x = features_of(text)
        ids = np.flatnonzero(x)
        out.append((ids, x[ids]))
    return out


@dataclass(frozen=True)
class Pairwise:
    """One-versus-one machines over `names`. Column i of `weights` tells pairs[i][0] (up) from pairs[i][1]."""

    names: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray
    bias: np.ndarray
    calibrations: tuple[linear.Calibration, ...]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The name with most votes, ties to the larger sum of probabilities; its probability is the mean
        of those of its pairs."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        margins = x @ self.weights + self.bias
        votes, sums = np.zeros(len(self.names)), np.zeros(len(self.names))
        for (a, b), margin, calibration in zip(self.pairs, margins, self.calibrations, strict=True):
            p = float(calibration(margin))
            votes[a if margin > 0 else b] += 1
            sums[a] += p
            sums[b] += 1 - p
        best = max(range(len(self.names)), key=lambda i: (votes[i], sums[i], -i))
        return self.names[best], float(sums[best] / (len(self.names) - 1))


def fit_pairwise(x: np.ndarray, k: np.ndarray, names: np.ndarray, weight: np.ndarray) -> Pairwise:
    labels = tuple(sorted(set(names)))
    pairs = tuple(combinations(range(len(labels)), 2))
    weights, bias, calibrations = np.zeros((x.shape[1], len(pairs)), np.float32), np.zeros(len(pairs)), []
    for at, (a, b) in enumerate(pairs):
        rows = np.flatnonzero((names == labels[a]) | (names == labels[b]))
        sign = np.where(names[rows] == labels[a], 1.0, -1.0)
        cost = COST * len(rows) / 2 / np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum())
        own = k[np.ix_(rows, rows)]
        solve = lambda some, own=own, sign=sign, cost=cost: linear.hinge_dual(own[np.ix_(some, some)], sign[some], cost[some])
        margin = linear.out_of_fold(own, linear.folds_of(sign, 3), solve)
        calibrations.append(linear.calibrate(margin, (sign > 0).astype(float), weight[rows]))
        alpha = solve(np.arange(len(rows)))
        weights[:, at] = alpha @ x[rows]
        bias[at] = alpha.sum()
    return Pairwise(labels, pairs, weights, bias, tuple(calibrations))


@dataclass(frozen=True)
class LanguageModel:
    families: Pairwise
    within: dict[str, Pairwise]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return UNKNOWN, 0.0
        x = features_of(text)
        family, p = self.families.predict(x)
        language, q = self.within[family].predict(x)
        return language, min(max(p * q, 0.0), 1.0)


def fit(sample: Sample) -> LanguageModel | None:
    if not len(sample):
        return None
    x = sample.dense(DIMS)
    k = linear.gram(x, 0.1)
    languages = sample.label.astype(str)
    families = np.array([family_of(v) for v in languages])
    within = {}
    for family in sorted(set(families)):
        rows = np.flatnonzero(families == family)
        within[family] = fit_pairwise(x[rows], k[np.ix_(rows, rows)], languages[rows], sample.weight[rows])
    return LanguageModel(fit_pairwise(x, k, families, sample.weight), within)


def train(docs: DataFrame, usable: Column | None = None, per_class: int = PER_LANGUAGE) -> LanguageModel | None:
    """Learn from the rows that have a language and meet `usable`."""
    rows = docs.where(F.lit(True) if usable is None else usable).select(F.col("doc_id").alias("key"), F.col("lang").alias("label"), "text")
    chosen, counts = class_sample(rows, "key", "label", per_class, "langid")
    texts = chosen.where(F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")).groupBy("key").agg(F.min(F.struct("text", "label")).alias("least"))
    return fit(featurised(texts.select("key", "least.label", "least.text"), counts, sample_features))


def identify(docs: DataFrame, model: LanguageModel | None, parts: int = 4, held: int = 2) -> DataFrame:
    """One row per document: the language and its score; `held_out` marks the fold that taught nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [model.predict(t) if model else (UNKNOWN, 0.0) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold_of("doc_id", parts) == held, F.lit(False)).alias("held_out"), "text")
    return given.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
