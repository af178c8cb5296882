"""Toxicity by a classifier chain.

Categories are predicted one after another: each is a logistic regression on indicators of words and of
their beginnings (so that an inflected form counts as its stem does), and on the
probabilities of the categories before it. In training those probabilities come from models fitted
without the row, on features chosen without it (out of fold), so a later model meets them as uncertain as they will be.

The chain is the same at every size: `low_quality`, which the labels tell; `kind_1` to `kind_4`, which are found in the
rows marked toxic by clustering what tells them from others (forms of abuse, or languages of it, that go together);
and `toxic` itself, whose calibrated probability decides. A category without a row is never likely.

A feature is chosen if the classes differ in it by more than `LEAST_GAIN` standard errors; how many there are follows
from the rows.

Cases: a null or empty text has no words and is not toxic; without labels of both kinds nothing is
toxic; one row of a label is enough to learn from; a word's count does not matter, so long texts are not diluted; repeated
rows get equal results, and a probability that equals the threshold is toxic; rows without a quality label teach
nothing of quality; of texts that share an id the least teaches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import linear
from millrace.llm.common import slices
from millrace.llm.training import PER_CLASS, Sample, featurised, labelled

#: Clusters of the rows marked toxic.
KINDS = 4
WORD_BITS = 18
MASK = (1 << WORD_BITS) - 1
#: Bytes of a word's beginning that count as features of their own.
PREFIXES = (4, 5, 6)
#: Standard errors by which the classes' shares of a feature must differ.
LEAST_GAIN = 4.0
LEAST_PROBABILITY = 0.4
L2 = 0.5
FOLDS = 5
#: ASCII letters in lower case; every other ASCII byte ends a word.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letter_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LETTERS).split()


def parts_of(word: bytes) -> list[int]:
    """The hashed word, and its hashed beginnings of `PREFIXES` bytes."""
    return [zlib.crc32(word) & MASK, *(zlib.crc32(word[:n], n) & MASK for n in PREFIXES if len(word) > n)]


class ChosenParts(dict):
    """The places of a word's parts among those the model chose, for each word met so far; starts anew at
    `limit` words."""

    def __init__(self, place: dict[int, int], limit: int = 300_000) -> None:
        super().__init__()
        self.place, self.limit = place, limit

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        self[word] = found = tuple(self.place[p] for p in parts_of(word) if p in self.place)
        return found

    def of(self, text: str | None) -> list[int]:
        """The distinct places that a text meets, in order."""
        return sorted({p for found in set(map(self.__getitem__, letter_words(text))) for p in found})


def sample_features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.array(sorted({p for w in set(letter_words(t)) for p in parts_of(w)}), np.int64), None) for t in texts]


@dataclass(frozen=True)
class Link:
    """One category: weights of the chosen words and of the earlier probabilities."""

    name: str
    words: np.ndarray
    earlier: np.ndarray
    bias: float
    calibration: linear.Calibration


@dataclass(frozen=True)
class ToxicityModel:
    #: Place of each chosen feature.
    place: dict[int, int]
    links: tuple[Link, ...]

    def probabilities(self, at: list[int]) -> list[float]:
        """The probability of each category for a text that meets the features at these places."""
        found: list[float] = []
        for link in self.links:
            margin = link.words[at].sum() + link.bias + float(np.dot(link.earlier, found)) if found else link.words[at].sum() + link.bias
            found.append(float(link.calibration(margin)))
        return found

    @property
    def names(self) -> list[str]:
        return [link.name for link in self.links]


def chosen_features(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The features in which rows marked toxic and others differ most clearly, in order."""
    count = [np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(toxic == v)] or [np.zeros(0, np.int64)]), minlength=1 << WORD_BITS) for v in (0, 1)]
    n = [(toxic == v).sum() for v in (0, 1)]
    share = [(c + 0.5) / (m + 1) for c, m in zip(count, n, strict=True)]
    pooled = (count[0] + count[1] + 1) / (n[0] + n[1] + 2)
    gain = np.abs(share[1] - share[0]) / np.sqrt(pooled * (1 - pooled) * (1 / (n[0] + 1) + 1 / (n[1] + 1)))
    return np.flatnonzero((gain >= LEAST_GAIN) & (count[0] + count[1] > 0))


def indicators(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    place = np.full(1 << WORD_BITS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)))
    for at, ids in enumerate(rows):
        met = place[ids]
        x[at, met[met >= 0]] = 1.0
    return x


def kinds_of(x: np.ndarray, toxic: np.ndarray, kinds: int = KINDS, rounds: int = 20) -> np.ndarray:
    """The kind of each row marked toxic, -1 for the others: clusters of directions in what tells toxic rows from
    others. The first centre is the mean, each next one the row farthest from all; so reruns agree."""
    tells = x[toxic == 1].mean(axis=0) > x[toxic == 0].mean(axis=0)
    some = np.flatnonzero((toxic == 1) & (x[:, tells].sum(axis=1) > 0))
    found = np.full(len(toxic), -1)
    if not len(some):
        return found
    told = x[np.ix_(some, tells)]
    told = told / np.linalg.norm(told, axis=1, keepdims=True)
    mean = told.mean(axis=0)
    centres = [mean / np.linalg.norm(mean)]
    while len(centres) < kinds:
        centres.append(told[np.argmin((told @ np.array(centres).T).max(axis=1))])
    centres = np.array(centres)
    for _ in range(rounds):
        nearest = (told @ centres.T).argmax(axis=1)
        sums = np.array([told[nearest == k].sum(axis=0) for k in range(kinds)])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres)
    found[some] = (told @ centres.T).argmax(axis=1)
    return found


def solved(x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the logistic regression, whichever of its two forms is the smaller problem."""
    if x.shape[1] <= x.shape[0]:
        return linear.logistic_primal(x, target, weight, L2)
    return linear.logistic_dual(x @ x.T, target, weight, L2) @ x


def fit(sample: Sample) -> ToxicityModel | None:
    """The chain learned from a sample with labels 0 and 1, or None if no row has one of them."""
    toxic = np.array([float(v == 1) for v in sample.label])
    if not 0 < toxic.sum() < len(toxic):
        return None
    rows = [ids.astype(np.int64) for ids, _ in sample.rows]
    fold = linear.folds_of(toxic, FOLDS)
    learning = [np.flatnonzero(fold != held) for held in range(FOLDS)]
    designs = [indicators(rows, chosen_features([rows[i] for i in some], toxic[some])) for some in learning]
    chosen = chosen_features(rows, toxic)
    x = indicators(rows, chosen)
    quality = sample.also if sample.also is not None else np.full(len(rows), np.nan)
    kind = kinds_of(x, toxic)
    everyone = np.ones(len(rows))
    targets = [("low_quality", (quality == 0).astype(float), (~np.isnan(quality)).astype(float))]
    targets += [(f"kind_{k + 1}", (kind == k).astype(float), everyone) for k in range(KINDS)]
    links: list[Link] = []
    before = np.zeros((len(rows), 0))
    for name, target, counts in [*targets, ("toxic", toxic, everyone)]:
        wide = lambda own, before=before: np.hstack([own, before, np.ones((len(own), 1))])
        margin = np.zeros(len(rows))
        for held, (some, design) in enumerate(zip(learning, designs, strict=True)):
            row = wide(design)
            margin[fold == held] = row[fold == held] @ solved(row[some], target[some], counts[some])
        calibration = linear.calibrate(margin, target, sample.weight * counts)
        weights = solved(wide(x), target, counts)
        links.append(Link(name, weights[: len(chosen)].astype(np.float32), weights[len(chosen) : -1], float(weights[-1]), calibration))
        before = np.hstack([before, calibration(margin)[:, None]])
    return ToxicityModel({int(c): at for at, c in enumerate(chosen)}, tuple(links))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel | None:
    return fit(featurised(*labelled(docs, labels, "toxic", per_class, "toxicity", also="quality"), sample_features))


def score(docs: DataFrame, model: ToxicityModel | None, least: float = LEAST_PROBABILITY) -> DataFrame:
    """One row per document: the probability, the verdict (toxic, or kept), and the categories with their
    probabilities, in the order of the chain."""
    names = model.names if model else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ChosenParts(model.place if model else {})
        for batch in slices(batches):
            rows = [model.probabilities(parts.of(t)) if model else [] for t in batch.column(1).to_pylist()]
            last = [r[-1] if r else 0.0 for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(last, pa.float64()), pa.array([p >= least for p in last], pa.bool_()), pa.array([p < least for p in last], pa.bool_()), pa.array([names] * len(rows), pa.list_(pa.string())), pa.array(rows, pa.list_(pa.float64()))],
                ["doc_id", "score", "toxic", "kept", "categories", "probabilities"],
            )

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id bigint, score double, toxic boolean, kept boolean, categories array<string>, probabilities array<double>")


def keep_clean(docs: DataFrame, model: ToxicityModel | None, least: float = LEAST_PROBABILITY) -> DataFrame:
    """The documents that are not toxic, with all their columns, in one pass without a shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ChosenParts(model.place if model else {})
        for batch in slices(batches):
            rows = [model is None or model.probabilities(parts.of(t))[-1] < least for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(rows, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
