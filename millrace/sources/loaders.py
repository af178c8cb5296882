"""Loader sources: rows from Python, staged with inferred types and written by a strategy."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import date, datetime
from decimal import Decimal
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.schema import schema_actions
from millrace.operators.write import append, delete_insert_by_range, merge
from millrace.plans.intervals import exclusive_end

BATCH_ROWS = 10_000
_ORDER = ("boolean", "bigint", "double", "string")


def infer_type(value: Any) -> str | None:
    """The column type that a Python value asks for; None for a missing one."""
    if value is None:
        return None
    for kinds, name in (((bool,), "boolean"), ((int,), "bigint"), ((float, Decimal), "double"), ((datetime,), "timestamp_ntz"), ((date,), "date"), ((str,), "string")):
        if isinstance(value, kinds):
            return name
    return "json"


def widen(a: str | None, b: str | None) -> str | None:
    """The type that holds both: whole numbers widen to fractions, dates to timestamps; anything else is an error."""
    if a == b or b is None:
        return a
    if a is None:
        return b
    pair = {a, b}
    for wide, members in (("double", {"bigint", "double"}), ("timestamp_ntz", {"date", "timestamp_ntz"}), ("json", {"json", "string"})):
        if pair <= members:
            return wide
    raise ValueError(f"a column holds both {a} and {b}")


def _cell(value: Any, kind: str) -> Any:
    if value is None:
        return None
    if kind == "json":
        return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)
    if kind == "double":
        return float(value)
    if kind == "timestamp_ntz" and not isinstance(value, datetime):
        return datetime(value.year, value.month, value.day)
    return value


def batches(rows: Iterable[dict[str, Any]], size: int = BATCH_ROWS) -> Iterator[list[dict[str, Any]]]:
    source = iter(rows)
    while batch := list(islice(source, size)):
        yield batch


def stage(spark: SparkSession, rows: Iterable[dict[str, Any]]) -> DataFrame:
    """All rows as one frame. Types are inferred batch by batch; a new column is null in the rows before it."""
    kinds: dict[str, str | None] = {}
    frames: list[tuple[list[dict[str, Any]], dict[str, str | None]]] = []
    for batch in batches(rows):
        for row in batch:
            for name, value in row.items():
                kinds[name] = widen(kinds.get(name), infer_type(value))
        frames.append((batch, kinds))
    final = {name: kind or "string" for name, kind in kinds.items()}
    schema = T.StructType([T.StructField(n, T._parse_datatype_string("string" if k == "json" else k)) for n, k in final.items()])
    staged = None
    for batch, _ in frames:
        part = spark.createDataFrame([tuple(_cell(row.get(n), k) for n, k in final.items()) for row in batch], schema)
        staged = part if staged is None else staged.unionByName(part)
    return staged if staged is not None else spark.createDataFrame([], schema)


def evolve_for(target: DataFrame, staged: DataFrame, contract: bool = False) -> DataFrame:
    """The target with the staged frame's new columns. Under a contract they are an error, as a changed type always is."""
    have, new = dict(target.dtypes), dict(staged.dtypes)
    if changed := [c for c in new if c in have and new[c] != have[c]]:
        raise ValueError(f"the types of {changed} changed")
    added = schema_actions(have, new)
    if contract and added:
        raise ValueError(f"the contract has no columns {[c for _, c, _ in added]}")
    return target.select("*", *(F.lit(None).cast(staged.schema[c].dataType).alias(c) for _, c, _ in added))


def load(target: DataFrame | None, staged: DataFrame, strategy: str, cursor: str | None = None, keys: list[str] | None = None, contract: bool = False) -> DataFrame:
    """The target after a load: `table` replaces it, the other strategies change it. The range that
    `delete_insert` replaces is the staged rows' own, its end made exclusive."""
    if strategy == "table" or target is None:
        return staged
    target = evolve_for(target, staged, contract)
    if strategy == "append":
        return append(target, staged)
    if strategy == "merge":
        return merge(target, staged, keys or [])
    if strategy == "delete_insert" and cursor:
        low, high = staged.agg(F.min(cursor), F.max(cursor)).first()
        if low is None:
            return target
        kind = target.schema[cursor].dataType
        return delete_insert_by_range(target, staged, cursor, F.lit(low).cast(kind), F.lit(exclusive_end(high)).cast(kind))
    raise ValueError(f"strategy {strategy!r} lacks what it needs")
