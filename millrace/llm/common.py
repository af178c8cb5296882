"""What the training-data operators share: tables, written intermediates, labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.shipping import ship_package
from millrace.storage import scratch, written

__all__ = ["class_sample", "hash_share", "scratch", "slices", "table", "written"]

#: Bytes of UTF-8 text that one slice of an Arrow batch holds at most, unless a single text is longer.
SLICE_BYTES = 4 << 20
#: 2 ** 63, as a float.
HALF_RANGE = 9.223372036854775808e18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = total = 0
        for row, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size + 1
        if start < batch.num_rows:
            yield batch.slice(start)


def hash_share(column: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the value and the salt alone."""
    return (F.xxhash64(column, F.lit(salt)) / F.lit(HALF_RANGE) + F.lit(1.0)) / F.lit(2.0)


def class_sample(df: DataFrame, key: str, label: str, per_class: int, salt: str) -> tuple[DataFrame, dict]:
    """Rows of `df` drawn by the hash of `key`: about `per_class` of each value of `label`, all of a
    rarer one. Returns the rows and the count of every class. Null labels are left out."""
    rows = df.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, count in sorted(counts.items(), key=lambda x: str(x[0])):
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / count))).otherwise(share)
    return rows.where(hash_share(F.col(key), salt) < share), counts
