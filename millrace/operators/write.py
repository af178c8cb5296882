"""Write strategies as rewrites: each gives the rows that the target holds afterwards.

Plain Parquet tables know no row-level update, so a change is a new version of the touched part: of the
whole table, or, with a partition column, of the partitions that the delta touches.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class WriteError(ValueError):
    """The delta does not fit the strategy."""


def aligned(delta: DataFrame, target: DataFrame) -> DataFrame:
    """The delta with the target's columns in the target's order and types; missing ones are null. Names are
    matched without regard to case."""
    have = {c.lower(): c for c in delta.columns}
    if extra := sorted(set(have) - {c.lower() for c in target.columns}):
        raise WriteError(f"columns {extra} are not in the target")
    return delta.select(*((F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields))


def append(target: DataFrame, delta: DataFrame) -> DataFrame:
    """All rows of both."""
    return target.unionByName(aligned(delta, target))


def delete_insert_by_key(target: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the delta holds go, the delta's rows come. A null key matches nothing and stays."""
    gone = delta.select(*keys).distinct()
    return target.join(gone, keys, "left_anti").select(*target.columns).unionByName(aligned(delta, target))


def delete_insert_by_range(target: DataFrame, delta: DataFrame, cursor: str, start, end) -> DataFrame:
    """Rows with start <= cursor < end go, the delta's rows come. Rows without a cursor stay."""
    inside = (F.col(cursor) >= F.lit(start)) & (F.col(cursor) < F.lit(end))
    return target.where(~F.coalesce(inside, F.lit(False))).unionByName(aligned(delta, target))


def duplicate_keys(delta: DataFrame, keys: list[str]) -> DataFrame:
    return delta.groupBy(*keys).count().where("count > 1")


def merge(target: DataFrame, delta: DataFrame, keys: list[str], exclude: list[str] | None = None, check: bool = True) -> DataFrame:
    """Matched rows take the delta's values but for the columns in `exclude`, new keys are added. A key that
    the delta holds twice is an error. Null keys match nothing: such rows of the delta are added.

    The plan is one full join on the keys: both sides are shuffled once, and neither is if the delta is small
    enough to broadcast as an anti join plus a join."""
    if check and (bad := duplicate_keys(delta, keys).limit(1).collect()):
        raise WriteError(f"the delta holds key {tuple(bad[0])[:-1]} more than once")
    keep = {c.lower() for c in exclude or []}
    new = aligned(delta, target)
    old, fresh = target.select(F.struct(*target.columns).alias("old"), *keys), new.select(F.struct(*new.columns).alias("new"), *keys)
    joined = old.join(fresh, keys, "full")
    columns = []
    for name in target.columns:
        taken = F.when(F.col("new").isNull(), F.col(f"old.`{name}`")).otherwise(F.col(f"new.`{name}`"))
        if name.lower() in keep:
            taken = F.when(F.col("old").isNull(), F.col(f"new.`{name}`")).otherwise(F.col(f"old.`{name}`"))
        columns.append(taken.alias(name))
    return joined.select(*columns)


def touched_partitions(target: DataFrame, delta: DataFrame, keys: list[str], partition: str) -> DataFrame:
    """Partitions that the delta's rows lie in, and those that hold older rows of its keys."""
    mine = delta.select(partition)
    theirs = target.join(delta.select(*keys).distinct(), keys, "left_semi").select(partition)
    return mine.union(theirs).distinct()


def partition_rewrite(target: DataFrame, delta: DataFrame, keys: list[str], partition: str) -> DataFrame:
    """The rows of the touched partitions after the delta's keys were replaced: what a dynamic partition
    overwrite has to write. The other partitions are not read."""
    touched = touched_partitions(target, delta, keys, partition)
    kept = target.join(touched, partition, "left_semi").join(delta.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*target.columns).unionByName(aligned(delta, target))


def overwrite_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Write the rows over the partitions they lie in and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two frames."""
    return reduce(and_, (left[k].eqNullSafe(right[k]) for k in keys))
