"""Labelled rows for the classifiers: a bounded sample, with its features computed on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import class_sample, slices
from millrace.llm.textstats import WordHashes, word_grams, words_of

#: Rows of each label value that a classifier is fitted on at most, by expectation.
PER_CLASS = 1000


def fold_of(key: str, parts: int) -> Column:
    """The fold of a row: the CRC-32 of its id's decimal text, modulo the number of parts."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(parts)


@dataclass(frozen=True)
class Sample:
    """Rows in the order of their keys. `rows` holds the (feature ids, values) of each; `weight` gives
    every class its share of the whole table, and sums to the number of rows; `also` is a second label, or None."""

    label: np.ndarray
    rows: list[tuple[np.ndarray, np.ndarray]]
    weight: np.ndarray
    also: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.rows)

    def dense(self, dims: int) -> np.ndarray:
        x = np.zeros((len(self.rows), dims), np.float32)
        for at, (ids, values) in enumerate(self.rows):
            x[at, ids] = values
        return x


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int, salt: str, usable: Column | None = None, also: str | None = None) -> tuple[DataFrame, dict]:
    """Texts of a sample of the labelled documents, as (key, label, also, text). Repeated labels of one document
    count once, the least value holds; of several texts under one id the least. The sampled labels are
    few by construction, so they are broadcast and the documents' texts are scanned once, unshuffled."""
    known = [F.col("doc_id").alias("key"), F.col(column).alias("__label"), (F.col(also).cast("int") if also in labels.columns else F.lit(None).cast("int")).alias("__also")]
    one = (labels if usable is None else labels.where(usable)).select(*known).where("key IS NOT NULL AND __label IS NOT NULL")
    one = one.groupBy("key").agg(F.min("__label").alias("label"), F.min("__also").alias("also"))
    chosen, counts = class_sample(one, "key", "label", per_class, salt)
    texts = docs.select(F.col("doc_id").alias("key"), "text").where(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "key").groupBy("key", "label", "also").agg(F.min("text").alias("text")), counts


def featurised(sample: DataFrame, counts: dict, features: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray | None]]]) -> Sample:
    """Compute features of (key, label, text) on the executors and gather them; without values every feature
    counts one. Of rows that agree in the least hash of their three-word runs, which near copies mostly do, one is
    kept: a group of copies must not outvote the rest. Rows without a key teach nothing, as they have no fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            texts = batch.column(3).to_pylist()
            prints = []
            for text in texts:
                words = hashes.of(words_of(text))
                grams = word_grams(words, min(3, max(1, len(words))))
                prints.append(int(grams.min()) if len(grams) else -1)
            found = features(texts)
            values = [None if v is None else v.astype(np.float32).tobytes() for _, v in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(prints, pa.int64()), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array(values, pa.binary())],
                ["key", "label", "also", "print", "ids", "vals"],
            )

    kind, key = (sample.schema[name].dataType.simpleString() for name in ("label", "key"))
    second = F.col("also") if "also" in sample.columns else F.lit(None).cast("int").alias("also")
    found = sample.select("key", "label", second, "text").mapInArrow(run, f"key {key}, label {kind}, also int, print bigint, ids binary, vals binary").collect()
    kept: dict = {}
    for row in sorted((r for r in found if r.key is not None), key=lambda r: (r.key, bytes(r.ids))):
        kept.setdefault((row.label, row.print), row)
    label = np.array([r.label for r in kept.values()], dtype=object)
    drawn = {v: int((label == v).sum()) for v in counts}
    counts = {v: n for v, n in counts.items() if drawn[v]}
    total = sum(counts.values()) or 1
    weight = np.array([counts[v] / total * len(kept) / drawn[v] for v in label], dtype=np.float64)
    rows = []
    for r in kept.values():
        ids = np.frombuffer(r.ids, np.int32)
        rows.append((ids, np.ones(len(ids), np.float32) if r.vals is None else np.frombuffer(r.vals, np.float32)))
    return Sample(label, rows, weight, np.array([np.nan if r.also is None else float(r.also) for r in kept.values()]))
