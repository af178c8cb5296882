"""The named queries of the library, each with the DuckDB statement that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("aggregates", "projection", "windows", "setops", "joins", "functions", "writes", "incremental", "quality", "sources", "projects")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in _MODULES:
        found |= importlib.import_module(f"{__name__}.{name}").QUERIES.functions()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in _MODULES:
        found |= importlib.import_module(f"{__name__}.{name}").QUERIES.oracles()
    return found
