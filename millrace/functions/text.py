"""String similarity that the engine has no function for, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of a common beginning, and how long a beginning counts.
PREFIX_SCALE = 0.1
LONGEST_PREFIX = 4
#: Similarity from which the beginning adds to it.
BOOST_FROM = 0.7


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    common: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                common.append(c)
                break
    m = len(common)
    if not m:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(common, other, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised for a common beginning."""
    base = jaro(a, b)
    if base <= BOOST_FROM:
        return base
    prefix = 0
    for x, y in zip(a[:LONGEST_PREFIX], b[:LONGEST_PREFIX], strict=False):
        if x != y:
            break
        prefix += 1
    return base + prefix * PREFIX_SCALE * (1 - base)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    """The similarity as a column of doubles; null if either side is."""

    @F.pandas_udf("double")
    def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(left, right, strict=True):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in known:
                known[pair] = jaro_winkler(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return similarity(a, b)
