"""Deterministic samples: the same rows for the same seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_order(keys: list[str], seed: int) -> Column:
    """MD5 of the seed and, for each key, its length and its text, joined by bars. Null keys count as length -1."""
    parts: list[Column] = [F.lit(str(seed))]
    for key in keys:
        text = F.col(key).cast("string")
        parts += [F.coalesce(F.length(text), F.lit(-1)).cast("string"), F.coalesce(text, F.lit(""))]
    return F.md5(F.concat_ws("|", *parts))


def hash_sample(frame: DataFrame, keys: list[str], seed: int, rows: int) -> DataFrame:
    """The first rows by hash, then by key: a top-k without a global sort."""
    return frame.orderBy(sample_order(keys, seed), *keys).limit(rows)
