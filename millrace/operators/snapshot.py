"""Slowly changing dimensions: versions with half-open validity.

A change is a new version of the whole table: versions are unioned and their ends recomputed by one window per key, which
stands for the update of closed rows and the insert of new ones. Keys are compared null-safely.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.write import same_keys

FROM, TO = "valid_from", "valid_to"


def differs(left: str, right: str, columns: list[str]) -> Column:
    """Whether any of the columns of two structs is distinct."""
    return reduce(or_, (~F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns))


def initial(source: DataFrame, start: Column) -> DataFrame:
    """Every row is an open version."""
    return source.withColumns({FROM: start, TO: F.lit(None).cast(source.select(start.alias("s")).schema["s"].dataType)})


def current(history: DataFrame, source: DataFrame, keys: list[str], changed: Column, start: Column, hard_deletes: bool = False, deleted_at: Column | None = None) -> DataFrame:
    """One observation of the source against the history. `changed` compares the structs `new` and `old`; `start` gives a
    new version's beginning from `new`. With hard deletes, open versions whose key is gone end at
    `deleted_at`; a key that comes back gets a new version from its reappearance."""
    columns = [c for c in history.columns if c not in (FROM, TO)]
    closed, open_ = history.where(F.col(TO).isNotNull()), history.where(F.col(TO).isNull())
    old = open_.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*history.columns).alias("old"))
    new = source.select(*(F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)), F.struct(*columns).alias("new"))
    condition = reduce(lambda a, b: a & b, (F.col(f"_k{i}").eqNullSafe(F.col(f"_n{i}")) for i in range(len(keys))))
    both = old.join(new, condition, "full")
    is_changed = F.col("old").isNotNull() & F.col("new").isNotNull() & F.coalesce(changed, F.lit(False))
    gone = F.col("new").isNull() & F.lit(hard_deletes)
    kind = dict(history.dtypes)[FROM]
    end = F.when(is_changed, start.cast(kind)).when(gone, (deleted_at if deleted_at is not None else F.lit(None)).cast(kind)).otherwise(F.col(f"old.{TO}"))
    kept = both.where("old IS NOT NULL").select(*(F.col(f"old.`{c}`").alias(c) for c in columns), F.col(f"old.{FROM}").alias(FROM), end.alias(TO))
    fresh = both.where(F.col("old").isNull() | is_changed).select(*(F.col(f"new.`{c}`").alias(c) for c in columns), start.cast(kind).alias(FROM), F.lit(None).cast(kind).alias(TO))
    return closed.unionByName(kept).unionByName(fresh)


def current_timestamp(history: DataFrame, source: DataFrame, keys: list[str], updated_at: str, hard_deletes: bool = False, deleted_at: Column | None = None) -> DataFrame:
    """A new version where `updated_at` advanced."""
    return current(history, source, keys, F.col(f"new.`{updated_at}`") > F.col(f"old.`{updated_at}`"), F.col(f"new.`{updated_at}`"), hard_deletes, deleted_at)


def current_check(history: DataFrame, source: DataFrame, keys: list[str], check: list[str], observed: Column, hard_deletes: bool = False) -> DataFrame:
    """A new version where any checked column is distinct, from the time of observation."""
    return current(history, source, keys, differs("new", "old", check), observed, hard_deletes, observed)


def closed_by_next(versions: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Versions end where the next of their key begins."""
    order = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_first())
    return versions.withColumn(FROM, F.col(start)).withColumn(TO, F.lead(start).over(order))


def check_changes(rows: DataFrame, keys: list[str], check: list[str], observed_at: str) -> DataFrame:
    """The first row of each key, and those distinct from the row before them in a checked column."""
    order = Window.partitionBy(*keys).orderBy(F.col(observed_at).asc_nulls_first())
    now, before = F.struct(*check), F.lag(F.struct(*check, F.lit(True).alias("_seen"))).over(order)
    marked = rows.withColumn("_now", now).withColumn("_before", before)
    return marked.where(F.col("_before._seen").isNull() | differs("_now", "_before", check)).drop("_now", "_before")


def historical_check(rows: DataFrame, keys: list[str], check: list[str], observed_at: str) -> DataFrame:
    """Versions of a full history of observations."""
    return closed_by_next(check_changes(rows, keys, check, observed_at), keys, observed_at)


def latest_version(history: DataFrame, keys: list[str]) -> DataFrame:
    """The version of each key that begins last, as a struct `latest`."""
    return history.groupBy(*keys).agg(F.max_by(F.struct(*history.columns), FROM).alias("latest"))


def _after(delta: DataFrame, history: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    latest = latest_version(history, keys).select(*(F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)), "latest")
    condition = reduce(lambda a, b: a & b, (delta[k].eqNullSafe(F.col(f"_l{i}")) for i, k in enumerate(keys)))
    joined = delta.join(latest, condition, "left").where(F.col("latest").isNull() | keep)
    return joined.select(*delta.columns)


def historical_check_apply(history: DataFrame, delta: DataFrame, keys: list[str], check: list[str], observed_at: str) -> DataFrame:
    """More observations: changes within the delta that come after the latest version and are distinct from it."""
    changes = check_changes(delta, keys, check, observed_at).withColumn("_row", F.struct(*check))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(observed_at).asc_nulls_first())) == 1
    later = F.col(observed_at) > F.col(f"latest.{FROM}")
    new = _after(changes, history, keys, later).withColumn("_first", first)
    latest = latest_version(history, keys).select(*(F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)), "latest")
    condition = reduce(lambda a, b: a & b, (new[k].eqNullSafe(F.col(f"_l{i}")) for i, k in enumerate(keys)))
    new = new.join(latest, condition, "left").where(F.col("latest").isNull() | ~F.col("_first") | differs("_row", "latest", check))
    return closed_by_next(history.drop(FROM, TO).unionByName(new.select(*delta.columns)), keys, observed_at)


def timestamp_changes(rows: DataFrame, keys: list[str], updated_at: str, observed_at: str) -> DataFrame:
    """The rows whose `updated_at` is distinct from that of the observation before."""
    order = Window.partitionBy(*keys).orderBy(F.col(observed_at).asc_nulls_first())
    marked = rows.withColumn("_place", F.row_number().over(order)).withColumn("_before", F.lag(updated_at).over(order))
    return marked.where((F.col("_place") == 1) | ~F.col("_before").eqNullSafe(F.col(updated_at))).drop("_place", "_before")


def historical_timestamp(rows: DataFrame, keys: list[str], updated_at: str, observed_at: str) -> DataFrame:
    return closed_by_next(timestamp_changes(rows, keys, updated_at, observed_at), keys, updated_at)


def historical_timestamp_apply(history: DataFrame, delta: DataFrame, keys: list[str], updated_at: str, observed_at: str) -> DataFrame:
    new = _after(timestamp_changes(delta, keys, updated_at, observed_at), history, keys, F.col(updated_at) > F.col(f"latest.{FROM}"))
    return closed_by_next(history.drop(FROM, TO).unionByName(new), keys, updated_at)


def historical_changes(rows: DataFrame, keys: list[str], updated_at: str) -> DataFrame:
    """Every row is a version."""
    return closed_by_next(rows, keys, updated_at)


def historical_changes_apply(history: DataFrame, delta: DataFrame, keys: list[str], updated_at: str) -> DataFrame:
    new = _after(delta, history, keys, F.col(updated_at) > F.col(f"latest.`{updated_at}`"))
    return closed_by_next(history.drop(FROM, TO).unionByName(new), keys, updated_at)


__all__ = ["FROM", "TO", "current_check", "current_timestamp", "historical_changes", "historical_changes_apply", "historical_check", "historical_check_apply", "historical_timestamp", "historical_timestamp_apply", "initial", "latest_version", "same_keys"]
