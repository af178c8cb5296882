"""Audits: frames of violating rows, measurements against thresholds, and the identity of an audit."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def not_null(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNull())


def unique(rows: DataFrame, *columns: str) -> DataFrame:
    """Keys without nulls that occur more than once, with their counts."""
    known = rows
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def accepted_values(rows: DataFrame, column: str, values: list[Any]) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(values))


def relationships(rows: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose value is not null and not among the parent's."""
    keys = parent.where(F.col(parent_column).isNotNull()).select(F.col(parent_column).alias(column)).distinct()
    return rows.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def custom(spark: SparkSession, template: str, relation: str, **arguments: Any) -> DataFrame:
    """Violations by any statement; @relation, @column and the other @names are replaced."""
    text = template.replace("@relation", relation)
    for name, value in sorted(arguments.items(), key=lambda x: -len(x[0])):
        text = text.replace(f"@{name}", str(value))
    return spark.sql(text)


@dataclass(frozen=True)
class Audit:
    """What is checked, how severe a violation is, and on which rows: of the delta, of the final table, or both."""

    name: str
    kind: str
    column: str = ""
    arguments: dict[str, Any] = field(default_factory=dict)
    severity: str = "error"
    scope: str = "final"

    def fingerprint(self) -> str:
        """Equal for equal audits, whatever the order of the arguments."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def effective_scope(scope: str, materialized: str) -> str:
    """Only incremental and snapshot models have a delta; any other is audited as a whole."""
    return scope if materialized in ("incremental", "snapshot") else "final"


def violations(audit: Audit, rows: DataFrame, parent: DataFrame | None = None) -> DataFrame:
    if audit.kind == "not_null":
        return not_null(rows, audit.column)
    if audit.kind == "unique":
        return unique(rows, *([audit.column] if audit.column else audit.arguments["columns"]))
    if audit.kind == "accepted_values":
        return accepted_values(rows, audit.column, audit.arguments["values"])
    if audit.kind == "relationships" and parent is not None:
        return relationships(rows, audit.column, parent, audit.arguments["field"])
    raise ValueError(f"unknown audit {audit.kind!r}")


@dataclass(frozen=True)
class Outcome:
    audit: str
    count: int
    status: str  # pass, warn or error

    @property
    def blocks(self) -> bool:
        return self.status == "error"


def run_audit(audit: Audit, rows: DataFrame, parent: DataFrame | None = None) -> Outcome:
    """Counts the violations in one job."""
    count = violations(audit, rows, parent).count()
    return Outcome(audit.name, count, "pass" if not count else audit.severity)


@dataclass(frozen=True)
class Thresholds:
    """Where a measured value warns and fails. Outside: a pair (low, high) that it should stay within."""

    warn_below: float | None = None
    error_below: float | None = None
    warn_above: float | None = None
    error_above: float | None = None
    warn_outside: tuple[float, float] | None = None
    error_outside: tuple[float, float] | None = None
    least_samples: int = 1


def judge(value: float | None, samples: int | None, limits: Thresholds) -> str:
    """pass, warn, error, or insufficient where there is no value or too few samples."""
    if value is None or samples is None or samples < limits.least_samples:
        return "insufficient"
    for status in ("error", "warn"):
        below, above, outside = (getattr(limits, f"{status}_{k}") for k in ("below", "above", "outside"))
        if (below is not None and value < below) or (above is not None and value > above) or (outside is not None and not outside[0] <= value <= outside[1]):
            return status
    return "pass"


def judged(value: Column, samples: Column, limits: Thresholds) -> Column:
    """The same verdict as a column, for a frame of many measurements."""
    verdict = F.when(value.isNull() | samples.isNull() | (samples < limits.least_samples), "insufficient")
    for status in ("error", "warn"):
        below, above, outside = (getattr(limits, f"{status}_{k}") for k in ("below", "above", "outside"))
        if below is not None:
            verdict = verdict.when(value < below, status)
        if above is not None:
            verdict = verdict.when(value > above, status)
        if outside is not None:
            verdict = verdict.when(~value.between(*outside), status)
    return verdict.otherwise("pass")


def measure(measurement: DataFrame, limits: Thresholds) -> tuple[str, float | None, int | None]:
    """Judge a frame of one row with the columns value and sample_count."""
    row = measurement.select("value", "sample_count").first()
    value, samples = (row["value"], row["sample_count"]) if row else (None, None)
    return judge(value, samples, limits), value, samples
