"""Relations of a warehouse: views, staged tables and their promotion, copies, removal."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREVIOUS, STAGING, BUILDING = "__previous__", "__staging__", "__building__"
LONGEST_NAME = 128


class AuditFailure(RuntimeError):
    """A blocking audit found violations; the live relation was left as it was."""


def artifact_name(prefix: str, name: str, longest: int = LONGEST_NAME) -> str:
    """The prefixed name, or where it is too long its beginning and twelve digits of its hash."""
    full = prefix + name
    if len(full) <= longest:
        return full
    digest = hashlib.sha256(full.encode()).hexdigest()[:12]
    return f"{full[: longest - 13]}_{digest}"


class Warehouse:
    """One schema of the catalog. Names are plain; every table is Parquet."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.schema = spark, schema
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")

    def name(self, relation: str) -> str:
        return f"`{self.schema}`.`{relation}`"

    def exists(self, relation: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.schema}.{relation}")

    def kind(self, relation: str) -> str:
        """table, view or other."""
        if not self.exists(relation):
            return "other"
        kind = self.spark.catalog.getTable(f"{self.schema}.{relation}").tableType
        return "view" if "VIEW" in kind else "table" if kind in ("MANAGED", "EXTERNAL") else "other"

    def read(self, relation: str) -> DataFrame:
        return self.spark.table(self.name(relation))

    def drop(self, relation: str) -> None:
        self.spark.sql(f"DROP {'VIEW' if self.kind(relation) == 'view' else 'TABLE'} IF EXISTS {self.name(relation)}")

    def rename(self, old: str, new: str) -> None:
        self.spark.sql(f"ALTER {'VIEW' if self.kind(old) == 'view' else 'TABLE'} {self.name(old)} RENAME TO {self.name(new)}")

    def create_view(self, relation: str, statement: str) -> None:
        if self.kind(relation) == "table":
            self.drop(relation)
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(relation)} AS {statement}")

    def write(self, relation: str, rows: DataFrame, mode: str = "overwrite", partition: str | None = None) -> None:
        if mode == "overwrite" and self.exists(relation):
            self.drop(relation)
        writer = rows.write.mode(mode).format("parquet")
        (writer.partitionBy(partition) if partition else writer).saveAsTable(self.name(relation))

    def append(self, relation: str, rows: DataFrame) -> None:
        self.spark.sql(f"REFRESH TABLE {self.name(relation)}")
        rows.select(*self.read(relation).columns).write.insertInto(self.name(relation))

    def rewrite_partitions(self, relation: str, rows: DataFrame, touched: list, partition: str, check: Callable[[DataFrame], None] | None = None) -> None:
        """Put `rows`, all that the touched partitions are to hold, in their place; files of other partitions stay. The
        rows are staged first, so they may read the relation, and a check that raises leaves it as it was."""
        staged = artifact_name(STAGING, relation)
        self.write(staged, rows, partition=partition)
        try:
            if check is not None:
                kept = self.read(relation).where(~F.coalesce(F.col(partition).isin(touched), F.lit(False)))
                check(kept.unionByName(self.read(staged)))
            filled = {r[0] for r in self.read(staged).select(partition).distinct().collect()}
            # A session of its own, as the mode is a setting of the session and models are built side by side.
            own = self.spark.newSession()
            own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            own.table(self.name(staged)).select(*self.read(relation).columns).write.mode("overwrite").insertInto(self.name(relation))
            kind = self.read(relation).schema[partition].dataType.simpleString()
            for value in touched:
                if value not in filled:
                    self.spark.sql(f"ALTER TABLE {self.name(relation)} DROP IF EXISTS PARTITION (`{partition}` = CAST('{value}' AS {kind}))")
            self.spark.sql(f"REFRESH TABLE {self.name(relation)}")
        finally:
            self.drop(staged)

    def promote(self, staged: str, live: str) -> None:
        """The staged relation takes the live one's name; the old one is gone only once the new one is there."""
        previous = artifact_name(PREVIOUS, live)
        if not self.exists(live):
            self.rename(staged, live)
            return
        if self.exists(previous):
            self.drop(previous)
        self.rename(live, previous)
        try:
            self.rename(staged, live)
        except Exception:
            self.rename(previous, live)
            raise
        self.drop(previous)

    def replace_staged(self, live: str, rows: DataFrame, check: Callable[[DataFrame], None] | None = None, partition: str | None = None) -> None:
        """Write to a staging relation, check what was written, then promote. If the check raises, the live
        relation is as it was. The rows may read the live relation: it is not touched before."""
        staged = artifact_name(STAGING, live)
        self.write(staged, rows, partition=partition)
        try:
            if check is not None:
                check(self.read(staged))
            self.promote(staged, live)
        finally:
            if self.exists(staged):
                self.drop(staged)

    def swap(self, a: str, b: str) -> None:
        between = artifact_name("__swap__", a)
        self.rename(a, between)
        self.rename(b, a)
        self.rename(between, b)

    def clone(self, relation: str, target: Warehouse) -> str:
        """Copy a table to another schema. What happened: cloned, replaced, missing or view."""
        kind = self.kind(relation)
        if kind == "other":
            return "missing"
        if kind == "view":
            return "view"
        existed = target.exists(relation)
        target.replace_staged(relation, self.read(relation))
        return "replaced" if existed else "cloned"

    def relations(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.schema) if not t.isTemporary)

    def stale(self, wanted: set[str]) -> list[str]:
        """Relations that no model owns, and what failed runs left."""
        return [r for r in self.relations() if r not in wanted]

    def clean(self, wanted: set[str], dry: bool = True) -> list[str]:
        found = self.stale(wanted)
        if not dry:
            for relation in found:
                self.drop(relation)
        return found
