"""Differences between relations: keyed and unkeyed rows, samples of them, and the verdict of a unit test."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.sampling import sample_order


@dataclass(frozen=True)
class Tolerance:
    """Numbers within `absolute`, or within `relative` of the larger magnitude, count as equal."""

    absolute: float = 0.0
    relative: float = 0.0


def same_value(a: Column, b: Column, tolerance: Tolerance | None = None) -> Column:
    """Null equals null; a null and a value differ whatever the tolerance."""
    if tolerance is None:
        return a.eqNullSafe(b)
    allowed = F.greatest(F.lit(tolerance.absolute), F.lit(tolerance.relative) * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(F.abs(a - b) <= allowed, a.isNull() & b.isNull())


@dataclass(frozen=True)
class RowDiff:
    """Options of a keyed comparison."""

    keys: list[str]
    exclude: list[str] = field(default_factory=list)
    tolerances: dict[str, Tolerance] = field(default_factory=dict)


def keyed_diff(left: DataFrame, right: DataFrame, options: RowDiff) -> DataFrame:
    """Every key with its class (equal, unequal, left_only, right_only) and the columns that differ. One full join."""
    common = [c for c in left.columns if c in right.columns and c not in options.keys and c not in options.exclude]
    a = left.select(*(F.col(k).alias(f"_a{i}") for i, k in enumerate(options.keys)), F.struct(*common, F.lit(1).alias("_here")).alias("a"))
    b = right.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(options.keys)), F.struct(*common, F.lit(1).alias("_here")).alias("b"))
    match = reduce(and_, (F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(options.keys))))
    both = a.join(b, match, "full")
    unequal = [F.when(~same_value(F.col(f"a.`{c}`"), F.col(f"b.`{c}`"), options.tolerances.get(c)), F.lit(c)) for c in common]
    differing = F.array_compact(F.array(*unequal)) if unequal else F.array().cast("array<string>")
    kind = F.when(F.col("b._here").isNull(), "left_only").when(F.col("a._here").isNull(), "right_only").when(F.size("differing") > 0, "unequal").otherwise("equal")
    present = F.col("a._here").isNotNull() & F.col("b._here").isNotNull()
    keyed = both.withColumn("differing", F.when(present, differing).otherwise(F.array().cast("array<string>")))
    keys = [F.when(F.col("a._here").isNotNull(), F.col(f"_a{i}")).otherwise(F.col(f"_b{i}")).alias(k) for i, k in enumerate(options.keys)]
    return keyed.select(*keys, kind.alias("class"), "differing", "a", "b")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("class").agg(F.count("*").alias("n"))


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose counts differ, with the surplus of each side. Both sides are aggregated together, before one shuffle."""
    columns = left.columns
    marked = left.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(right.select(*columns).withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1)))
    counted = marked.groupBy(*columns).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).where("_l <> _r")
    return counted.select(*columns, F.greatest(F.col("_l") - F.col("_r"), F.lit(0)).alias("left_surplus"), F.greatest(F.col("_r") - F.col("_l"), F.lit(0)).alias("right_surplus"))


def diff_samples(diff: DataFrame, keys: list[str], kind: str, rows: int = 3, seed: int = 0) -> DataFrame:
    """A few keys of a class, the same ones every time."""
    return diff.where(F.col("class") == kind).orderBy(sample_order(keys, seed), *keys).limit(rows)


def within_guard(row_counts: list[int | None], most: int = 10_000_000) -> bool:
    """Whether a full comparison is small enough; an unknown count is not."""
    return all(n is not None and n <= most for n in row_counts)


@dataclass(frozen=True)
class TestVerdict:
    passed: bool
    actual_rows: int
    expected_rows: int
    missing: int
    unexpected: int
    samples: tuple[tuple[str, ...], ...] = ()


def compare_expected(actual: DataFrame, expected: DataFrame, most_rows: int = 3, most_columns: int = 12, most_chars: int = 120) -> TestVerdict:
    """The verdict of a unit test: equal multisets over the expected columns. Samples show a few differing rows,
    column by column where exactly one row is missing and one is unexpected."""
    columns = expected.columns
    if lost := [c for c in columns if c not in actual.columns]:
        raise ValueError(f"the actual rows lack the columns {lost}")
    typed = expected.select(*(F.col(c).cast(actual.schema[c].dataType).alias(c) for c in columns))
    diff = multiset_diff(actual.select(*columns), typed)
    total = diff.agg(F.coalesce(F.sum("right_surplus"), F.lit(0)).alias("missing"), F.coalesce(F.sum("left_surplus"), F.lit(0)).alias("unexpected")).first()
    counts = actual.select(F.lit(0)).count(), expected.select(F.lit(0)).count()
    samples: list[tuple[str, ...]] = []
    if total.missing or total.unexpected:
        rows = diff.limit(most_rows).collect()
        shown = columns[:most_columns]
        if (total.missing, total.unexpected) == (1, 1):
            want, got = (next(r for r in rows if r[s]) for s in ("right_surplus", "left_surplus"))
            samples = [(c, str(want[c])[:most_chars], str(got[c])[:most_chars]) for c in shown if want[c] != got[c]]
        else:
            samples = [("missing" if r["right_surplus"] else "unexpected", *(str(r[c])[:most_chars] for c in shown)) for r in rows]
    return TestVerdict(not total.missing and not total.unexpected, *counts, int(total.missing), int(total.unexpected), tuple(samples))


def bounded(frame: DataFrame, cursor: str | None, low=None, high=None) -> tuple[DataFrame, bool]:
    """Rows within cursor bounds, and whether they are all rows for lack of a cursor."""
    if cursor is None or cursor not in frame.columns:
        return frame, True
    parts = [F.col(cursor) >= F.lit(low)] * (low is not None) + [F.col(cursor) < F.lit(high)] * (high is not None)
    return (frame.where(reduce(and_, parts)) if parts else frame), False


__all__ = ["RowDiff", "TestVerdict", "Tolerance", "bounded", "compare_expected", "diff_counts", "diff_samples", "keyed_diff", "multiset_diff", "same_value", "within_guard"]
