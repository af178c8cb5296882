"""Cursor-driven processing: reading bounds, windowing inputs, and running a model in microbatches."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.write import append, delete_insert_by_range, merge
from millrace.plans.intervals import Interval, Scalar, split


def literal(value: Scalar) -> Column:
    """A cursor value as a column literal; moments have no zone."""
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value.isoformat()).cast("date") if isinstance(value, date) else F.lit(value)


def cursor_bounds(frame: DataFrame, *cursors: str) -> dict[str, tuple[Scalar | None, Scalar | None]]:
    """Least and greatest value of each cursor, in one scan."""
    row = frame.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in cursors for f in (F.min, F.max))).first()
    return {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in cursors}


def within(cursor: str, window: Interval) -> Column:
    """The filter that a cursor window puts on an input; it reaches the scan."""
    return (F.col(cursor) >= literal(window.start)) & (F.col(cursor) < literal(window.end))


def apply_increment(target: DataFrame, delta: DataFrame, strategy: str, window: Interval | None = None, cursor: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """The target after one increment by a strategy."""
    if strategy == "append":
        return append(target, delta)
    if strategy == "merge":
        return merge(target, delta, keys or [])
    if strategy == "delete_insert" and window is not None and cursor is not None:
        return delete_insert_by_range(target, delta, cursor, literal(window.start), literal(window.end))
    raise ValueError(f"strategy {strategy!r} lacks what it needs")


def run_microbatches(model: Callable[[Interval], DataFrame], window: Interval, grain: str, size: int, store: Callable[[DataFrame, Interval], None], most: int | None = None) -> list[Interval]:
    """Run `model` for each batch of the window in order and hand its rows to `store`, which replaces the
    batch's range. Returns the batches that were done; a failure leaves the earlier ones in place."""
    done = []
    for batch in split(window, grain, size)[:most]:
        store(model(batch), batch)
        done.append(batch)
    return done


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int, tie: str) -> DataFrame:
    """Events with a running session number per key: a new one starts after a gap of more than `gap_seconds`."""
    order = Window.partitionBy(key).orderBy(time, tie)
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    fresh = F.when(seconds - F.lag(seconds).over(order) <= gap_seconds * 1_000_000, 0).otherwise(1)
    return events.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def islands(intervals: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """Intervals that overlap or touch made one, per key: the data-side twin of merging intervals."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) <= reach, 0).otherwise(1)
    numbered = intervals.withColumn("_island", fresh).withColumn("_island", F.sum("_island").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def unseen(events: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Events that are not known yet, each once: an idempotent append."""
    return events.dropDuplicates([key]).join(known.select(key), key, "left_anti")
