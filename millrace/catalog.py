"""Relations: reading the input tables, temp views, and the relation operations of a warehouse."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> None:
    """Make the named tables available to SQL as temp views."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
