"""Lineage and checks from the analysed plan: no statement is parsed here, the engine's analyser says it all."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: The engine's error conditions, by the kind of finding.
FINDINGS = {
    "unknown column": ("UNRESOLVED_COLUMN", "UNRESOLVED_FIELD", "FIELD_NOT_FOUND"),
    "ambiguous column": ("AMBIGUOUS_REFERENCE", "AMBIGUOUS_COLUMN"),
    "unknown relation": ("TABLE_OR_VIEW_NOT_FOUND",),
    "unknown function": ("UNRESOLVED_ROUTINE", "UNRESOLVABLE_TABLE_VALUED_FUNCTION"),
    "type": ("DATATYPE_MISMATCH", "CAST_INVALID_INPUT", "INCOMPATIBLE_COLUMN_TYPE"),
    "arity": ("WRONG_NUM_ARGS", "NUM_COLUMNS_MISMATCH"),
    "grouping": ("MISSING_AGGREGATION", "MISSING_GROUP_BY", "GROUPING", "UNSUPPORTED_GROUPING"),
    "limit": ("INVALID_LIMIT_LIKE_EXPRESSION",),
    "syntax": ("PARSE_SYNTAX_ERROR",),
}


def check_statement(spark: SparkSession, sql: str) -> tuple[str, str] | None:
    """(kind, condition) of what is wrong with a statement, or None. No job runs."""
    try:
        spark.sql(sql).schema  # noqa: B018
    except AnalysisException as error:
        condition = error.getCondition() or ""
        return next((kind for kind, names in FINDINGS.items() if condition.startswith(names)), "other"), condition
    return None


def output_types(spark: SparkSession, sql: str) -> dict[str, tuple[str, bool]]:
    """Columns of a statement with type and nullability."""
    return {f.name: (f.dataType.simpleString(), f.nullable) for f in spark.sql(sql).schema.fields}


def _attributes(expression) -> list[tuple[int, str]]:
    found = expression.references().toSeq()
    return [(found.apply(i).exprId().id(), found.apply(i).name()) for i in range(found.size())]


def column_lineage(frame: DataFrame) -> dict[str, set[str]]:
    """For each output column the source columns that it is made of, as relation.column where the relation has
    a name. Walks the analysed plan by the ids of its attributes, so aliases and joins do not matter."""
    plan = frame._jdf.queryExecution().analyzed()
    made: dict[int, set[int]] = {}
    sources: dict[int, str] = {}

    def note(named) -> None:
        kind = named.getClass().getSimpleName()
        if kind == "Alias":
            made.setdefault(named.exprId().id(), set()).update(i for i, _ in _attributes(named.child()))

    def walk(node, relation: str | None) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "SubqueryAlias":
            relation = node.identifier().name()
        if kind == "View":
            relation = node.desc().identifier().table()
        if kind in ("LogicalRelation", "LocalRelation", "LogicalRDD", "OneRowRelation", "HiveTableRelation", "Range"):
            output = node.output()
            for i in range(output.size()):
                attribute = output.apply(i)
                sources[attribute.exprId().id()] = f"{relation}.{attribute.name()}" if relation else attribute.name()
            return
        expressions = node.expressions()
        for i in range(expressions.size()):
            note(expressions.apply(i))
        if kind == "Union":
            first = node.output()
            for c in range(node.children().size()):
                other = node.children().apply(c).output()
                for i in range(first.size()):
                    if first.apply(i).exprId().id() != other.apply(i).exprId().id():
                        made.setdefault(first.apply(i).exprId().id(), set()).add(other.apply(i).exprId().id())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), relation)

    walk(plan, None)

    def roots(attribute: int, seen: frozenset[int]) -> set[str]:
        if attribute in sources:
            return {sources[attribute]}
        return set().union(*(roots(i, seen | {attribute}) for i in made.get(attribute, ()) if i not in seen))

    output = plan.output()
    return {output.apply(i).name(): roots(output.apply(i).exprId().id(), frozenset()) for i in range(output.size())}


def required_columns(frame: DataFrame) -> dict[str, set[str]]:
    """For each scan of the optimised plan the columns that are really read."""
    text = frame._jdf.queryExecution().executedPlan().toString()
    return {str(i): set(re.findall(r"(\w+):", schema)) for i, schema in enumerate(re.findall(r"ReadSchema: struct<([^>]*)>", text))}
