"""Row sources that need no input."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_numbers(spark: SparkSession, rows: int) -> DataFrame:
    """Numbers from 0 on, made on the executors."""
    return spark.range(rows).withColumnRenamed("id", "n")


def date_spine(spark: SparkSession, start: date, end: date, step: str = "1 day") -> DataFrame:
    """Dates from start to before end."""
    ends = F.date_sub(F.lit(end.isoformat()).cast("date"), 1)
    spine = F.explode(F.sequence(F.lit(start.isoformat()).cast("date"), ends, F.expr(f"INTERVAL {step}")))
    return spark.range(1).select(spine.alias("day")) if start < end else spark.createDataFrame([], "day date")


def table_from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
