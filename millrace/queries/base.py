"""How a query is registered: a Spark callable, and the DuckDB text that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.catalog import read_table, register_views

Query = Callable[[SparkSession, str], DataFrame]


class QuerySet:
    """Collects queries. `sql` registers a statement over the tables; `frame` decorates a function."""

    def __init__(self) -> None:
        self._functions: dict[str, Query] = {}
        self._oracles: dict[str, str] = {}

    def sql(self, name: str, spark_sql: str, tables: tuple[str, ...] | list[str], oracle: str | None = None) -> None:
        """Register a statement. Without `oracle`, the same text serves both engines."""
        names = tuple(tables)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            register_views(spark, sf_dir, names)
            return spark.sql(spark_sql)

        self._add(name, run, spark_sql if oracle is None else oracle)

    def frame(self, name: str, oracle: str | None) -> Callable[[Query], Query]:
        """Register a function of (spark, sf_dir); `oracle` is None where SQL cannot express it."""

        def wrap(function: Query) -> Query:
            self._add(name, function, oracle)
            return function

        return wrap

    def _add(self, name: str, function: Query, oracle: str | None) -> None:
        if name in self._functions:
            raise ValueError(f"query {name} is registered twice")
        self._functions[name] = function
        if oracle is not None:
            self._oracles[name] = oracle

    def functions(self) -> dict[str, Query]:
        return dict(self._functions)

    def oracles(self) -> dict[str, str]:
        return dict(self._oracles)


def tables_of(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, sf_dir, name) for name in names]
