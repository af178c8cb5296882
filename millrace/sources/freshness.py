"""What version of the data a source holds, and whether it changed."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Freshness:
    """An observation: how it was made, and the version that was seen."""

    source: str
    strategy: str
    version: str | None

    def identity(self) -> str:
        return hashlib.sha256("\x1f".join((self.source, self.strategy, self.version or "")).encode()).hexdigest()


def observe_column(source: str, frame: DataFrame, column: str) -> Freshness:
    """The greatest value of a column."""
    (value,) = frame.agg(F.max(column)).first()
    return Freshness(source, f"column:{column}", None if value is None else str(value))


def observe_sql(spark: SparkSession, source: str, statement: str) -> Freshness:
    row = spark.sql(statement).first()
    return Freshness(source, "sql", None if row is None or row[0] is None else str(row[0]))


def observe_files(spark: SparkSession, source: str, path: str) -> Freshness:
    """How many files lie under a path, their bytes, and the latest change, by the store's own listing: no data is read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    count = size = latest = 0
    for status in files.globStatus(target) or []:
        found = files.listFiles(status.getPath(), True)
        while found.hasNext():
            one = found.next()
            if not one.getPath().getName().startswith(("_", ".")):
                count, size, latest = count + 1, size + one.getLen(), max(latest, one.getModificationTime())
    return Freshness(source, "files", f"{count}:{size}:{latest}" if count else None)


def observe_table(spark: SparkSession, source: str, table: str) -> Freshness:
    """The files of a catalog table; a view's version is unknown."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").collect()
    return Freshness(source, "table", observe_files(spark, source, rows[0].data_type).version if rows else None)


def compare(before: Freshness | None, now: Freshness, tolerated: timedelta | None = None) -> str:
    """new, unknown, unchanged, tolerated (changed by no more than the lag that is allowed) or changed."""
    if now.version is None:
        return "unknown"
    if before is None or before.version is None:
        return "new"
    if before.identity() == now.identity():
        return "unchanged"
    if tolerated is not None:
        try:
            lag = datetime.fromisoformat(now.version) - datetime.fromisoformat(before.version)
        except ValueError:
            return "changed"
        if timedelta(0) <= lag <= tolerated:
            return "tolerated"
    return "changed"


def too_old(version: datetime, clock: datetime, most: timedelta) -> bool:
    return clock - version > most
