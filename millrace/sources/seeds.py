"""Typed CSV seeds, with a policy for what counts as missing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.schema import spark_type


@dataclass(frozen=True)
class SeedSettings:
    """CSV dialect and missing values. `na_values` is a list for all columns or one for each of some columns;
    with `keep_default_na` the empty text is missing too."""

    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    encoding: str = "UTF-8"
    trim: bool = False
    na_values: tuple[str, ...] | dict[str, tuple[str, ...]] = ()
    keep_default_na: bool = True
    options: dict[str, str] = field(default_factory=dict)


def missing_values(settings: SeedSettings, column: str) -> list[str]:
    own = settings.na_values.get(column, ()) if isinstance(settings.na_values, dict) else settings.na_values
    return [*own, *([""] if settings.keep_default_na else [])]


def with_missing(column: Column, settings: SeedSettings, name: str) -> Column:
    """The text, or null where it counts as missing."""
    values = missing_values(settings, name)
    return F.when(~column.isin(values), column) if values else column


def read_seed(spark: SparkSession, path: str, columns: dict[str, str], settings: SeedSettings | None = None) -> DataFrame:
    """A CSV with a header as a typed frame. All fields are read as text, missing ones set to null, and the
    rest cast; a value that does not fit its type is an error."""
    settings = settings or SeedSettings()
    text = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    options = {"header": "true", "sep": settings.delimiter, "quote": settings.quote, "escape": settings.escape, "encoding": settings.encoding, "ignoreLeadingWhiteSpace": str(settings.trim).lower(), "ignoreTrailingWhiteSpace": str(settings.trim).lower(), "enforceSchema": "false", "emptyValue": "", "nullValue": "\u0000", "multiLine": "true", "mode": "FAILFAST"}
    rows = spark.read.schema(text).options(**(options | settings.options)).csv(path)
    return rows.select(*(with_missing(F.col(f"`{name}`"), settings, name).cast(spark_type(kind)).alias(name) for name, kind in columns.items()))
