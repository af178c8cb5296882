"""Projects: models, sources, seeds, functions and their graph."""

from __future__ import annotations

import fnmatch
import graphlib
import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from pyspark.errors import AnalysisException

from millrace.operators.quality import Audit

MARKER = re.compile(r"__(ref|source|seed|table_fn|udf)\(\s*[\"']([^\"']+)[\"']\s*\)")
CURSOR = re.compile(r"__cursor_(start|end)\(\)")
PLACEHOLDER = re.compile(r"@@@(\w+)")
MACRO = re.compile(r"@(?:sql|py)\.(\w+)\(([^()]*)\)")


class ProjectError(ValueError):
    """The project does not hold together."""


@dataclass(frozen=True)
class Model:
    """A statement and how its relation is kept."""

    name: str
    sql: str
    materialized: str = "view"  # view, table, incremental, snapshot or custom
    columns: dict[str, str] = field(default_factory=dict)
    contract: bool = False
    dynamic_columns: str | None = None
    audits: tuple[Audit, ...] = ()
    tags: tuple[str, ...] = ()
    path: str = ""
    enabled: bool = True
    strategy: str | None = None  # append, delete_insert or merge
    unique_key: tuple[str, ...] = ()
    merge_exclude_columns: tuple[str, ...] = ()
    on_schema_change: str = "append_new_columns"
    replay_on_change: str = "forward"
    cursor: str | None = None
    cursor_grain: str | None = None
    cursor_watermark_mode: str = "all"
    cursor_inputs: tuple[str, ...] = ()  # the references whose bounds open the window; all that have the cursor if empty
    cursor_future_distance: str | None = None  # how far past the clock a cursor may claim
    lookback: str | None = None
    batch_size: int | None = None
    batch_concurrency: int = 1
    max_microbatches: int | None = None
    unaccounted_partition_policy: str | None = None  # synthesize, recover_empty or recover_all
    snapshot_strategy: str | None = None  # timestamp or check
    updated_at: str | None = None
    check_columns: tuple[str, ...] = ()
    observed_at: str | None = None
    historical_input: bool = False
    initial_valid_from: Any = None
    valid_from_column: str = "valid_from"
    valid_to_column: str = "valid_to"
    snapshot_full_refresh: bool = False
    invalidate_hard_deletes: bool = False
    partition_by: str | None = None
    pre_hooks: tuple[Any, ...] = ()
    post_hooks: tuple[Any, ...] = ()
    materialize: Callable | None = None
    migrate_from: str | None = None
    old_name_view: bool = False
    constants: dict[str, Any] = field(default_factory=dict)

    def references(self) -> list[tuple[str, str]]:
        return list(_references(self.sql))

    def query_hash(self) -> str:
        """Equal for statements that differ in comments, white space and letter case outside of quotes only."""
        return _query_hash(self.sql)

    def config_hash(self) -> str:
        kept = {k: v for k, v in vars(self).items() if k not in ("sql", "materialize", "audits", "columns", "path", "tags")}
        return hashlib.sha256(repr(sorted(kept.items())).encode()).hexdigest()

    def schema_hash(self) -> str:
        return hashlib.sha256(repr(sorted(self.columns.items())).encode()).hexdigest()


@dataclass(frozen=True)
class Source:
    """A table of the catalog, a Parquet path, a statement, or a loader's rows. Its version is the greatest value of
    `freshness_column`, what `freshness_sql` gives, or else what the files' metadata say; a change of times
    by no more than `tolerated` is none."""

    name: str
    path: str | None = None
    table: str | None = None
    sql: str | None = None
    loader: Callable[[], Iterable[dict]] | None = None
    strategy: str = "table"
    cursor: str | None = None
    unique_key: tuple[str, ...] = ()
    freshness_column: str | None = None
    freshness_sql: str | None = None
    tolerated: str | None = None

    def relation(self, own: Callable[[str], str]) -> str:
        """What stands for the source in a statement, in any session; `own` names a relation of the warehouse."""
        if self.loader is not None:
            return own(f"source_{self.name}")
        return f"parquet.`{self.path}`" if self.path else f"({self.sql})" if self.sql else str(self.table)


@dataclass(frozen=True)
class Seed:
    name: str
    path: str
    columns: dict[str, str]


@dataclass(frozen=True)
class Function:
    """A SQL function: arguments, what it returns (a type, or TABLE (...)), and its body. Or a Python one: `python`
    takes and gives pandas series (a scalar, for an aggregate), and has no body."""

    name: str
    arguments: str
    returns: str
    body: str = ""
    python: Callable | None = None

    def ddl(self, schema: str | None = None) -> str:
        """The statement that makes the function, in a schema or for the session."""
        place = f"FUNCTION `{schema}`.{self.name}" if schema else f"TEMPORARY FUNCTION {self.name}"
        return f"CREATE OR REPLACE {place}({self.arguments}) RETURNS {self.returns} RETURN {self.body}"

    def version(self) -> str:
        """What changes when the function does."""
        return self.ddl() if self.python is None else f"{self.name}:{self.returns}:{self.python.__code__.co_code.hex()}:{self.python.__code__.co_consts!r}"

    def register(self, spark: Any, schema: str | None = None) -> None:
        if self.python is None:
            try:
                spark.sql(self.ddl(schema))
            except AnalysisException as error:
                # The session still knows a function that went with its schema.
                if schema is None or error.getCondition() != "ROUTINE_NOT_FOUND":
                    raise
                spark.sql(f"DROP FUNCTION IF EXISTS `{schema}`.{self.name}")
                spark.sql(self.ddl(schema))
        else:
            from pyspark.sql import functions as F

            spark.udf.register(self.name, F.pandas_udf(self.python, self.returns))


@lru_cache(maxsize=1 << 16)
def _references(sql: str) -> tuple[tuple[str, str], ...]:
    return tuple(dict.fromkeys(MARKER.findall(sql)))


@lru_cache(maxsize=1 << 16)
def _query_hash(sql: str) -> str:
    return hashlib.sha256(normalised(sql).encode()).hexdigest()


def normalised(sql: str) -> str:
    parts = re.split(r"('(?:[^']|'')*')", re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.DOTALL))
    return "".join(p if i % 2 else re.sub(r"\s+", " ", p).lower() for i, p in enumerate(parts)).strip(" ;")


@dataclass
class Project:
    models: dict[str, Model] = field(default_factory=dict)
    sources: dict[str, Source] = field(default_factory=dict)
    seeds: dict[str, Seed] = field(default_factory=dict)
    functions: dict[str, Function] = field(default_factory=dict)
    macros: dict[str, Callable[..., str]] = field(default_factory=dict)
    constants: dict[str, Any] = field(default_factory=dict)

    def add(self, *nodes: Model | Source | Seed | Function) -> Project:
        places = {Model: self.models, Source: self.sources, Seed: self.seeds, Function: self.functions}
        for node in nodes:
            place = places[type(node)]
            if node.name in place:
                raise ProjectError(f"{node.name} is declared twice")
            place[node.name] = node
        return self

    def graph(self) -> dict[str, set[str]]:
        """What every model reads, by node id: a model's name, or kind:name for the others."""
        found: dict[str, set[str]] = {}
        places = {"ref": self.models, "source": self.sources, "seed": self.seeds, "udf": self.functions, "table_fn": self.functions}
        for model in self.models.values():
            if not model.enabled:
                continue
            found[model.name] = set()
            for kind, name in model.references():
                if name not in places[kind]:
                    raise ProjectError(f"{model.name} reads an unknown {kind} {name}")
                found[model.name].add(name if kind == "ref" else f"{'function' if kind in ('udf', 'table_fn') else kind}:{name}")
        return found

    def order(self, chosen: set[str] | None = None) -> list[str]:
        """Models in an order that builds what is read first."""
        graph = self.graph()
        try:
            order = list(graphlib.TopologicalSorter({k: sorted(v) for k, v in sorted(graph.items())}).static_order())
        except graphlib.CycleError as error:
            raise ProjectError(f"models read each other in a circle: {' -> '.join(error.args[1])}") from error
        return [n for n in order if n in graph and (chosen is None or n in chosen)]

    def levels(self) -> list[list[str]]:
        """Models in groups: each reads of the groups before it only."""
        graph = self.graph()
        sorter = graphlib.TopologicalSorter({k: sorted(v) for k, v in sorted(graph.items())})
        try:
            sorter.prepare()
        except graphlib.CycleError as error:
            raise ProjectError(f"models read each other in a circle: {' -> '.join(error.args[1])}") from error
        found = []
        while sorter.is_active():
            ready = sorter.get_ready()
            sorter.done(*ready)
            if level := sorted(n for n in ready if n in graph):
                found.append(level)
        return found

    def render(self, model: Model, names: Callable[[str, str], str], cursor: tuple[str, str] | None = None, values: dict[str, str] | None = None) -> str:
        """The statement with macros, constants, placeholders, references and cursor bounds filled in."""
        sql = model.sql
        for _ in range(20):
            filled = MACRO.sub(lambda m: self.macros[m[1]](*(a.strip() for a in m[2].split(",") if a.strip())), sql)
            if filled == sql:
                break
            sql = filled
        for key, value in {**self.constants, **model.constants}.items():
            sql = re.sub(rf"@const\.{re.escape(key)}\b", lambda _, v=value: f"'{v}'" if isinstance(v, str) else str(v), sql)
        sql = PLACEHOLDER.sub(lambda m: (values or {})[m[1]], sql)
        if CURSOR.search(sql):
            if cursor is None:
                raise ProjectError(f"{model.name} uses the cursor's bounds but has none")
            sql = CURSOR.sub(lambda m: cursor[m[1] == "end"], sql)
        return MARKER.sub(lambda m: names(m[1], m[2]), sql)

    # --- selection ---------------------------------------------------------------------------------

    def upstream(self, name: str) -> set[str]:
        graph, found, open_ = self.graph(), set(), [name]
        while open_:
            for node in graph.get(open_.pop(), ()):
                if node not in found:
                    found.add(node)
                    open_.append(node)
        return found

    def downstream(self, name: str) -> set[str]:
        graph, found, open_ = self.graph(), set(), [name]
        while open_:
            at = open_.pop()
            for node, reads in graph.items():
                if at in reads and node not in found:
                    found.add(node)
                    open_.append(node)
        return found

    def _matching(self, text: str) -> set[str]:
        if text.startswith("tag:"):
            return {m.name for m in self.models.values() if text[4:] in m.tags}
        if text.startswith("path:"):
            prefix = text[5:].rstrip("/")
            return {m.name for m in self.models.values() if m.path == prefix or m.path.startswith(f"{prefix}/") or fnmatch.fnmatchcase(m.path, prefix)}
        for kind, place in (("source:", self.sources), ("seed:", self.seeds)):
            if text.startswith(kind):
                return {f"{kind}{n}" for n in place if fnmatch.fnmatchcase(n, text[len(kind) :])}
        return {m for m in self.models if fnmatch.fnmatchcase(m, text)}

    def _term(self, term: str) -> set[str]:
        if "~" in term:
            start, end = (self._matching(t) for t in term.split("~", 1))
            between = set().union(*(self.downstream(s) | {s} for s in start)) if start else set()
            return between & (set().union(*(self.upstream(e) | {e} for e in end)) if end else set())
        up, down = term.startswith("+"), term.endswith("+")
        base = self._matching(term.strip("+"))
        found = set(base)
        for node in base:
            found |= (self.upstream(node) if up else set()) | (self.downstream(node) if down else set())
        return found

    def select(self, selectors: Iterable[str], exclude: Iterable[str] = ()) -> set[str]:
        """Nodes that any selector meets, but for those that any exclusion meets. Terms joined by a comma
        must all be met; +x adds what x reads, x+ what reads it, a~b is what lies between."""
        meet = lambda text: set.intersection(*(self._term(t.strip()) for t in text.split(",")))
        found = set().union(*(meet(s) for s in selectors)) if selectors else set(self.models)
        return found - set().union(*(meet(s) for s in exclude)) if exclude else found
