"""Schema comparison: type families, contracts, enforcement and evolution."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names of each family.
FAMILIES = {
    "integer": ("BIGINT", "INTEGER", "INT", "SMALLINT", "TINYINT", "INT8", "INT64", "INT4", "INT2", "LONG", "SHORT", "BYTE", "BYTEINT"),
    "decimal": ("DECIMAL", "NUMERIC", "NUMBER", "BIGNUMERIC"),
    "float": ("FLOAT", "REAL", "DOUBLE", "DOUBLE PRECISION", "FLOAT4", "FLOAT8", "FLOAT64"),
    "string": ("VARCHAR", "TEXT", "STRING", "CHAR", "CHARACTER VARYING", "NVARCHAR"),
    "boolean": ("BOOLEAN", "BOOL"),
    "timestamp": ("TIMESTAMP", "TIMESTAMP_NTZ", "TIMESTAMP_LTZ", "TIMESTAMP_TZ", "TIMESTAMPTZ", "TIMESTAMP WITH TIME ZONE", "TIMESTAMP WITHOUT TIME ZONE"),
    "date": ("DATE",),
    "datetime": ("DATETIME",),
}
#: Spark's type for a declared name, where the two differ.
SPARK_NAMES = {"INTEGER": "INT", "INT8": "BIGINT", "INT64": "BIGINT", "INT4": "INT", "INT2": "SMALLINT", "TEXT": "STRING", "VARCHAR": "STRING", "NVARCHAR": "STRING", "NUMBER": "DECIMAL", "NUMERIC": "DECIMAL", "REAL": "FLOAT", "DATETIME": "TIMESTAMP_NTZ", "TIMESTAMP": "TIMESTAMP_NTZ", "TIMESTAMP_TZ": "TIMESTAMP", "TIMESTAMPTZ": "TIMESTAMP", "TIMESTAMP_LTZ": "TIMESTAMP", "BOOL": "BOOLEAN", "FLOAT64": "DOUBLE", "DOUBLE PRECISION": "DOUBLE", "VARIANT": "VARIANT", "JSON": "VARIANT"}


@dataclass(frozen=True)
class TypeShape:
    """A type for comparison: two types are the same if their shapes are."""

    name: str
    family: str
    precision: int | None = None
    scale: int | None = None
    length: int | None = None


def normalise_type(text: str) -> TypeShape:
    """The shape of a type's text; what is in no family is compared as upper-case text without spaces."""
    plain = " ".join(text.strip().upper().split())
    match = re.fullmatch(r"([A-Z0-9_ ]+?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", plain)
    name = match[1].strip() if match else ""
    family = next((f for f, names in FAMILIES.items() if name in names), "other")
    if family == "other":
        return TypeShape(re.sub(r"\s", "", plain), "other")
    first, second = (int(x) if x else None for x in (match[2], match[3]))
    if family == "decimal":
        return TypeShape("DECIMAL", family, 38 if first is None else first, second or 0)
    if family == "string":
        return TypeShape("STRING", family, length=first)
    return TypeShape(SPARK_NAMES.get(name, name), family)


def spark_type(text: str) -> T.DataType:
    """The Spark type of a declared type."""
    shape = normalise_type(text)
    if shape.family == "decimal":
        return T.DecimalType(min(shape.precision, 38), shape.scale)
    if shape.family == "string":
        return T.StringType()
    return T._parse_datatype_string(SPARK_NAMES.get(shape.name, shape.name) if shape.family != "other" else text)


@dataclass(frozen=True)
class Finding:
    column: str
    kind: str
    expected: str = ""
    found: str = ""


def compare_schemas(expected: dict[str, str], found: DataFrame | dict[str, str], dynamic: str | None = None, dynamic_type: str | None = None) -> list[Finding]:
    """Missing, extra and differently typed columns, by name without regard to case. Extra columns that match
    `dynamic` are a family that may have any number of members of `dynamic_type`."""
    types = {f.name: f.dataType.simpleString() for f in found.schema.fields} if isinstance(found, DataFrame) else found
    have = {k.lower(): (k, v) for k, v in types.items()}
    findings = []
    for name, kind in expected.items():
        if name.lower() not in have:
            findings.append(Finding(name, "missing", kind))
        elif normalise_type(have[name.lower()][1]) != normalise_type(kind) and spark_type(have[name.lower()][1]) != spark_type(kind):
            findings.append(Finding(name, "type", kind, have[name.lower()][1]))
    known = {k.lower() for k in expected}
    for key, (name, kind) in have.items():
        if key in known:
            continue
        if dynamic is None or not re.fullmatch(dynamic, name, re.IGNORECASE):
            findings.append(Finding(name, "extra", "", kind))
        elif dynamic_type is not None and spark_type(kind) != spark_type(dynamic_type):
            findings.append(Finding(name, "type", dynamic_type, kind))
    return findings


def enforce_types(frame: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Cast the declared columns whose type differs; a value that cannot be cast is an error. Undeclared
    columns are left alone, and nothing is rebuilt if all types fit."""
    want = {k.lower(): spark_type(v) for k, v in declared.items()}
    if all(want.get(f.name.lower(), f.dataType) == f.dataType for f in frame.schema.fields):
        return frame
    return frame.select(*(F.col(f"`{f.name}`").cast(want.get(f.name.lower(), f.dataType)).alias(f.name) for f in frame.schema.fields))


#: What may be done when a delta's schema is not the target's.
ON_SCHEMA_CHANGE = ("append_new_columns", "sync_all_columns", "ignore", "fail")


def schema_actions(target: dict[str, str], delta: dict[str, str], policy: str = "append_new_columns") -> list[tuple[str, str, str]]:
    """(action, column, type) in the order they are to be done."""
    if policy not in ON_SCHEMA_CHANGE:
        raise ValueError(f"unknown policy {policy}")
    have, new = ({k.lower(): (k, v) for k, v in x.items()} for x in (target, delta))
    added = [(k, v) for key, (k, v) in new.items() if key not in have]
    removed = [(k, v) for key, (k, v) in have.items() if key not in new]
    changed = [(have[key][0], v) for key, (_, v) in new.items() if key in have and spark_type(v) != spark_type(have[key][1])]
    if policy == "fail" and (added or removed or changed):
        raise ValueError(f"the schema changed: added {added}, removed {removed}, retyped {changed}")
    if policy in ("ignore", "fail"):
        return []
    actions = [("add", k, v) for k, v in added]
    if policy == "sync_all_columns":
        actions += [("drop", k, v) for k, v in removed] + [("retype", k, v) for k, v in changed]
    return actions


def evolve(frame: DataFrame, actions: list[tuple[str, str, str]]) -> DataFrame:
    """The frame after the actions: added columns are null."""
    for action, column, kind in actions:
        if action == "add":
            frame = frame.withColumn(column, F.lit(None).cast(spark_type(kind)))
        elif action == "drop":
            frame = frame.drop(column)
        elif action == "retype":
            frame = frame.withColumn(column, F.col(f"`{column}`").cast(spark_type(kind)))
        elif action == "rename":
            frame = frame.withColumnRenamed(column, kind)
        else:
            raise ValueError(f"unknown action {action}")
    return frame
