"""Building a project: rendering, windows, writes, audits and promotion, model by model."""

from __future__ import annotations

import json
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import asdict, dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import compare, snapshot
from millrace.operators.incremental import apply_increment, cursor_bounds, within
from millrace.operators.quality import Outcome, effective_scope, run_audit
from millrace.operators.schema import compare_schemas, enforce_types, evolve, schema_actions
from millrace.operators.warehouse import BUILDING, STAGING, AuditFailure, Warehouse, artifact_name
from millrace.operators.write import append, delete_insert_by_key, merge, touched_partitions
from millrace.plans.intervals import Completion, Interval, Scalar, gaps_to_run, parse_duration, project_coverage, raw_bounds, replay_start, safety_horizon, split
from millrace.plans.planner import PlanEntry, State, plan, sources_seen, state_of
from millrace.plans.project import Model, Project, ProjectError, Source
from millrace.sources import freshness
from millrace.sources.loaders import load, stage
from millrace.sources.seeds import read_seed

STATE_TABLE = "_model_state"
SOURCE_TABLE = "_source_state"
BATCH_TABLE = "_batch_log"
_STATE = "model string, state string, at timestamp"
_SOURCES = "source string, strategy string, version string, at timestamp"
_BATCHES = "model string, kind string, low string, high string, empty boolean, at timestamp"


@dataclass
class Result:
    model: str
    action: str
    status: str  # done, failed or skipped
    audits: list[Outcome] = field(default_factory=list)
    batches: int = 0
    error: str = ""


def sql_literal(value: Scalar) -> str:
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'"
    return f"DATE '{value.isoformat()}'" if isinstance(value, date) else str(value)


class Engine:
    """One project in one warehouse. State is append-only; the latest row of a model counts."""

    def __init__(self, spark: SparkSession, project: Project, warehouse: Warehouse) -> None:
        self.spark, self.project, self.warehouse = spark, project, warehouse
        #: The versions of the sources that each model reads, as the running build saw them.
        self._seen: dict[str, str] = {}

    # --- names and inputs --------------------------------------------------------------------------

    def _name(self, kind: str, name: str) -> str:
        """What stands for a node in a statement. It means the same in any session, so that views can use it; a Python
        function alone belongs to the session."""
        if kind == "ref":
            return self.warehouse.name(name)
        if kind == "source":
            return self.project.sources[name].relation(self.warehouse.name)
        if kind == "seed":
            return self.warehouse.name(f"seed_{name}")
        return name if self.project.functions[name].python is not None else f"`{self.warehouse.schema}`.{name}"

    def _input(self, kind: str, name: str) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM {self._name(kind, name)}")

    def prepare(self) -> None:
        """Loads, seeds and functions. A seed is written anew only if its file changed."""
        for source in self.project.sources.values():
            if source.loader is not None:
                name = f"source_{source.name}"
                target = self.warehouse.read(name) if self.warehouse.exists(name) else None
                rows = load(target, stage(self.spark, source.loader()), source.strategy, source.cursor, list(source.unique_key))
                self.warehouse.replace_staged(name, rows)
        known = self.observed()
        for seed in self.project.seeds.values():
            now, name = freshness.observe_files(self.spark, f"seed:{seed.name}", seed.path), f"seed_{seed.name}"
            before = known.get(f"seed:{seed.name}")
            if not self.warehouse.exists(name) or before is None or before.version != now.version or set(self.warehouse.read(name).columns) != set(seed.columns):
                self.warehouse.replace_staged(name, read_seed(self.spark, seed.path, seed.columns))
        for function in self.project.functions.values():
            function.register(self.spark, self.warehouse.schema)

    # --- freshness ---------------------------------------------------------------------------------

    def observed(self) -> dict[str, freshness.Freshness]:
        """The last observation of every source and seed."""
        if not self.warehouse.exists(SOURCE_TABLE):
            return {}
        latest = self.warehouse.read(SOURCE_TABLE).groupBy("source").agg(F.max_by(F.struct("strategy", "version"), "at").alias("seen"))
        return {r.source: freshness.Freshness(r.source, r.seen.strategy, r.seen.version) for r in latest.collect()}

    def _observe(self, source: Source) -> freshness.Freshness:
        name = f"source:{source.name}"
        if source.freshness_sql:
            return freshness.observe_sql(self.spark, name, source.freshness_sql)
        if source.freshness_column:
            return freshness.observe_column(name, self._input("source", source.name), source.freshness_column)
        if source.path:
            return freshness.observe_files(self.spark, name, source.path)
        if source.sql:
            return freshness.Freshness(name, "statement", source.sql)
        return freshness.observe_table(self.spark, name, source.table or self.warehouse.name(f"source_{source.name}"))

    def observe(self, record: bool = True) -> dict[str, str]:
        """The version of every source and seed that counts: the one before, where the change is tolerated. A version
        that cannot be known counts as a new one each time."""
        known, rows, found = self.observed(), [], {}
        seen = [(s, self._observe(s)) for s in self.project.sources.values()]
        seen += [(None, freshness.observe_files(self.spark, f"seed:{s.name}", s.path)) for s in self.project.seeds.values()]
        for source, now in seen:
            lag = parse_duration(source.tolerated) if source and source.tolerated else None
            verdict = freshness.compare(known.get(now.source), now, timedelta(days=lag.days + 30 * lag.months, seconds=lag.seconds) if lag else None)
            counts = known[now.source] if verdict in ("unchanged", "tolerated") else now
            found[now.source] = f"{counts.strategy}:{counts.version}" if verdict != "unknown" else f"unknown at {datetime.now().isoformat()}"
            if verdict in ("new", "changed"):
                rows.append((now.source, now.strategy, now.version, datetime.now()))
        if record and rows:
            self.warehouse.write(SOURCE_TABLE, self.spark.createDataFrame(rows, _SOURCES), mode="append")
        return found

    def frame(self, model: Model, window: Interval | None = None) -> DataFrame:
        bounds = None if window is None else (sql_literal(window.start), sql_literal(window.end))
        return self.spark.sql(self.project.render(model, self._name, bounds))

    # --- state -------------------------------------------------------------------------------------

    def states(self) -> dict[str, State]:
        if not self.warehouse.exists(STATE_TABLE):
            return {}
        latest = self.warehouse.read(STATE_TABLE).groupBy("model").agg(F.max_by("state", "at").alias("state"))
        return {r.model: State(**json.loads(r.state)) for r in latest.collect()}

    def remember(self, model: Model, sources: str = "") -> None:
        row = [(model.name, json.dumps(asdict(state_of(self.project, model, sources))), datetime.now())]
        self.warehouse.write(STATE_TABLE, self.spark.createDataFrame(row, _STATE), mode="append")

    def plan(self, select: list[str] | None = None, full_refresh: bool = False, sources: dict[str, str] | None = None) -> list[PlanEntry]:
        """What a build would do. Sources are looked at, and what was seen is not recorded."""
        chosen = None if select is None else self.project.select(select)
        sources = self.observe(record=False) if sources is None else sources
        return plan(self.project, self.states(), set(self.warehouse.relations()), chosen, full_refresh, sources)

    # --- building ----------------------------------------------------------------------------------

    def build(self, select: list[str] | None = None, full_refresh: bool = False, window: Interval | None = None, workers: int = 1) -> list[Result]:
        """Build in dependency order, independent models side by side. Where a model fails, what reads it is skipped."""
        self.prepare()
        for model in self.project.models.values():
            self.migrate(model)
        sources = self.observe()
        self._seen = sources_seen(self.project, sources)
        entries = {e.model: e for e in self.plan(select, full_refresh, sources)}
        graph = {n: {x for x in reads if x in entries} for n, reads in self.project.graph().items() if n in entries}
        results: dict[str, Result] = {}
        running: dict[Future, str] = {}
        with ThreadPoolExecutor(workers) as pool:
            waiting = list(entries)
            while waiting or running:
                for name in [n for n in waiting if graph[n] <= set(results)]:
                    waiting.remove(name)
                    if bad := [u for u in sorted(graph[name]) if results[u].status != "done"]:
                        results[name] = Result(name, entries[name].action, "skipped", error=f"{bad[0]} was not built")
                    else:
                        running[pool.submit(self._run, entries[name], window)] = name
                if running:
                    for future in wait(running, return_when=FIRST_COMPLETED)[0]:
                        results[running.pop(future)] = future.result()
        return [results[n] for n in entries]

    def _run(self, entry: PlanEntry, window: Interval | None) -> Result:
        model, result = self.project.models[entry.model], Result(entry.model, entry.action, "done")
        if entry.action == "skip":
            # A view that stays reads new data by itself; what it read is remembered for what reads it.
            if self._seen.get(model.name, "") != getattr(self.states().get(model.name), "sources", ""):
                self.remember(model, self._seen.get(model.name, ""))
            return result
        try:
            self._hooks(model.pre_hooks)
            self._materialize(model, entry, window or entry.window, result)
            self._hooks(model.post_hooks)
            self.remember(model, self._seen.get(model.name, ""))
        except Exception as error:  # the run goes on with what does not depend on this model
            result.status, result.error = "failed", f"{type(error).__name__}: {error}"[:500]
        return result

    def _hooks(self, hooks: tuple) -> None:
        for hook in hooks:
            hook(self) if callable(hook) else self.spark.sql(hook)

    def _audit(self, model: Model, rows: DataFrame, result: Result, scope: str = "final") -> None:
        for audit in model.audits:
            wanted = effective_scope(audit.scope, model.materialized)
            if scope not in wanted.split("_and_"):
                continue
            parent = self.warehouse.read(audit.arguments["to"]) if audit.kind == "relationships" else None
            outcome = run_audit(audit, rows, parent)
            result.audits.append(outcome)
            if outcome.blocks:
                raise AuditFailure(f"{audit.name} found {outcome.count} rows")

    def _shaped(self, model: Model, rows: DataFrame) -> DataFrame:
        """Types enforced and the contract checked, before anything is written."""
        rows = enforce_types(rows, model.columns) if model.columns else rows
        if model.contract and (findings := compare_schemas(model.columns, rows, model.dynamic_columns)):
            raise ProjectError(f"the contract of {model.name} is broken: {findings}")
        return rows

    def _materialize(self, model: Model, entry: PlanEntry, window: Interval | None, result: Result) -> None:
        live = model.name
        if model.materialized == "custom" and model.materialize is not None:
            model.materialize(self, model)
        elif model.materialized == "view":
            if own := [n for kind, n in model.references() if kind in ("udf", "table_fn") and self.project.functions[n].python is not None]:
                raise ProjectError(f"a view lasts longer than the Python function {own[0]}; make {live} a table")
            self._shaped(model, self.frame(model))
            self.warehouse.create_view(live, self.project.render(model, self._name))
            self._audit(model, self.warehouse.read(live), result)
        elif model.materialized == "table":
            self.warehouse.replace_staged(live, self._shaped(model, self.frame(model)), lambda rows: self._audit(model, rows, result), model.partition_by)
        elif model.materialized == "snapshot":
            self._snapshot(model, entry.action, result)
        elif model.materialized == "incremental":
            self._incremental(model, entry, window, result)
        else:
            raise ProjectError(f"{model.name} has an unknown materialization {model.materialized}")

    def window_of(self, model: Model, entry: PlanEntry) -> Interval | None:
        """The window from the data: the bounds of the cursor's inputs, what the target already holds, and how far the
        lookback or the replay of a change reaches back. It ends at the safety horizon at the latest."""
        chosen = [(kind, name) for kind, name in model.references() if kind in ("ref", "source") and (not model.cursor_inputs or name in model.cursor_inputs)]
        inputs = [self._input(kind, name) for kind, name in chosen]
        upstream = [cursor_bounds(i, model.cursor)[model.cursor] for i in inputs if model.cursor in i.columns]
        reached = None
        if entry.action not in ("create", "replace") and self.warehouse.exists(model.name):
            reached = cursor_bounds(self.warehouse.read(model.name), model.cursor)[model.cursor][1]
        window = raw_bounds(reached, upstream, model.cursor_grain, model.cursor_watermark_mode)
        if window is None:
            return None
        start, end = window.start, window.end
        if reached is not None and entry.backfill:
            start = min(start, replay_start(window, backfill=parse_duration(entry.backfill)))
        elif reached is not None and model.lookback:
            start = replay_start(window, lookback=parse_duration(model.lookback))
        if model.cursor_future_distance and not isinstance(end, int):
            clock = datetime.now() if isinstance(end, datetime) else date.today()
            end = min(end, safety_horizon(clock, parse_duration(model.cursor_future_distance), model.cursor_grain or "second"))
        return Interval(start, end)

    def completions(self, model: Model) -> list[Completion]:
        """The batches of a model that were done, in order."""
        if not self.warehouse.exists(BATCH_TABLE):
            return []
        read = {"int": int, "date": date.fromisoformat, "datetime": datetime.fromisoformat}
        rows = self.warehouse.read(BATCH_TABLE).where(F.col("model") == model.name).orderBy("at").collect()
        return [Completion(Interval(read[r.kind](r.low), read[r.kind](r.high)), i, r.empty) for i, r in enumerate(rows)]

    def _log_batch(self, model: Model, batch: Interval, empty: bool) -> None:
        text = lambda v: str(v) if isinstance(v, int) else v.isoformat()
        row = [(model.name, type(batch.start).__name__, text(batch.start), text(batch.end), empty, datetime.now())]
        self.warehouse.write(BATCH_TABLE, self.spark.createDataFrame(row, _BATCHES), mode="append")

    def gaps(self, model: Model) -> list[Interval]:
        """The intervals between a model's first and last batch that its policy runs again."""
        done = self.completions(model)
        if not done or not model.unaccounted_partition_policy:
            return []
        whole = Interval(min(c.interval.start for c in done), max(c.interval.end for c in done))
        return gaps_to_run(project_coverage(whole, done)[0], model.unaccounted_partition_policy)

    def _batches(self, model: Model, entry: PlanEntry, window: Interval | None) -> list[Interval | None]:
        if window is None or not model.batch_size:
            return [window]
        again = [] if entry.action in ("create", "replace") else self.gaps(model)
        grain = model.cursor_grain or "second"
        return [b for one in [*again, window] for b in split(one, grain, model.batch_size)][: model.max_microbatches]

    def _incremental(self, model: Model, entry: PlanEntry, window: Interval | None, result: Result) -> None:
        if model.cursor and window is None:
            window = self.window_of(model, entry)
            if window is None or window.empty:
                return
        batches = self._batches(model, entry, window)
        if entry.action in ("create", "replace") or not self.warehouse.exists(model.name):
            self._first(model, batches, result)
            return
        again = entry.action == "replay" or (model.lookback is not None and model.cursor is not None)
        for batch, delta in self._deltas(model, batches):
            self._audit(model, delta, result, "delta")
            self._change(model, delta, batch, again, result)
            self._done(model, batch, delta, result)

    def _done(self, model: Model, batch: Interval | None, delta: DataFrame, result: Result) -> None:
        result.batches += 1
        if batch is not None and model.batch_size:
            self._log_batch(model, batch, delta.limit(1).count() == 0)

    def _deltas(self, model: Model, batches: list[Interval | None]):
        """Each batch with its rows, staged: what is audited and logged is what is written. Up to `batch_concurrency`
        batches are computed side by side; they are handed on in order."""
        names = [artifact_name(STAGING, f"{model.name}__{i}") for i in range(len(batches))]

        def staged(at: int) -> DataFrame:
            self.warehouse.write(names[at], self._shaped(model, self.frame(model, batches[at])))
            return self.warehouse.read(names[at])

        ahead = max(1, model.batch_concurrency)
        with ThreadPoolExecutor(ahead) as pool:
            running = {i: pool.submit(staged, i) for i in range(min(ahead, len(batches)))}
            try:
                for at, batch in enumerate(batches):
                    yield batch, running.pop(at).result()
                    self.warehouse.drop(names[at])
                    if at + ahead < len(batches):
                        running[at + ahead] = pool.submit(staged, at + ahead)
            finally:
                wait(running.values())
                for name in names:
                    if self.warehouse.exists(name):
                        self.warehouse.drop(name)

    def _first(self, model: Model, batches: list[Interval | None], result: Result) -> None:
        """All batches go to a relation of their own, which is audited and takes the live name last: readers never see a
        part of them."""
        building = artifact_name(BUILDING, model.name)
        if self.warehouse.exists(building):
            self.warehouse.drop(building)
        done: list[tuple[Interval | None, bool]] = []
        try:
            for batch, delta in self._deltas(model, batches):
                self._audit(model, delta, result, "delta")
                if not self.warehouse.exists(building):
                    self.warehouse.write(building, delta, partition=model.partition_by)
                elif model.strategy == "merge":
                    self.warehouse.replace_staged(building, merge(self.warehouse.read(building), delta, list(model.unique_key), list(model.merge_exclude_columns)), None, model.partition_by)
                else:
                    self.warehouse.append(building, delta)
                result.batches += 1
                done.append((batch, delta.limit(1).count() == 0))
            self._audit(model, self.warehouse.read(building), result)
            self.warehouse.promote(building, model.name)
        finally:
            if self.warehouse.exists(building):
                self.warehouse.drop(building)
        for batch, empty in done:
            if batch is not None and model.batch_size:
                self._log_batch(model, batch, empty)

    def _change(self, model: Model, delta: DataFrame, batch: Interval | None, again: bool, result: Result) -> None:
        """One increment. Rows that only come are appended; where the target is partitioned, only the partitions that
        change are rewritten; otherwise, or if its columns change, the target is written anew and promoted."""
        name, partition, keys = model.name, model.partition_by, list(model.unique_key)
        target = self.warehouse.read(name)
        actions = schema_actions(dict(target.dtypes), dict(delta.dtypes), model.on_schema_change)
        grown = evolve(target, actions)
        delta = delta.select(*(c for c in delta.columns if c.lower() in {t.lower() for t in grown.columns}))
        strategy = model.strategy or "append"
        by_key = strategy == "delete_insert" and (batch is None or not model.cursor)
        by_range = batch is not None and model.cursor is not None and (strategy == "delete_insert" and not by_key or strategy == "append" and again)
        check = lambda rows: self._audit(model, rows, result)

        def after(rows: DataFrame) -> DataFrame:
            if strategy == "merge":
                return merge(rows, delta, keys, list(model.merge_exclude_columns))
            if by_key:
                return delete_insert_by_key(rows, delta, keys)
            if by_range:
                return apply_increment(rows, delta, "delete_insert", batch, model.cursor)
            return append(rows, delta)

        if not actions and strategy == "append" and not by_range:
            rows = append(target.limit(0), delta)
            check(target.unionByName(rows))
            self.warehouse.append(name, rows)
            return
        if not actions and partition and partition in delta.columns:
            if by_range:
                moved = target.where(within(model.cursor, batch)).select(partition).union(delta.select(partition)).distinct()
            else:
                moved = touched_partitions(target, delta, keys, partition)
            touched = [r[0] for r in moved.collect()]
            if all(v is not None for v in touched):
                self.warehouse.rewrite_partitions(name, after(target.where(F.col(partition).isin(touched))), touched, partition, check if model.audits else None)
                return
        self.warehouse.replace_staged(name, after(grown), check, partition)

    def _snapshot(self, model: Model, action: str, result: Result) -> None:
        rows, keys, check = self._shaped(model, self.frame(model)), list(model.unique_key), list(model.check_columns)
        names = {snapshot.FROM: model.valid_from_column, snapshot.TO: model.valid_to_column}
        first = action == "replace" or not self.warehouse.exists(model.name)
        known = None if first else self.warehouse.read(model.name).withColumnsRenamed({v: k for k, v in names.items()})
        kind = model.snapshot_strategy or "timestamp"
        if model.historical_input:
            if kind == "check":
                history = snapshot.historical_check(rows, keys, check, model.observed_at) if first else snapshot.historical_check_apply(known, rows, keys, check, model.observed_at)
            elif model.observed_at:
                history = snapshot.historical_timestamp(rows, keys, model.updated_at, model.observed_at) if first else snapshot.historical_timestamp_apply(known, rows, keys, model.updated_at, model.observed_at)
            else:
                history = snapshot.historical_changes(rows, keys, model.updated_at) if first else snapshot.historical_changes_apply(known, rows, keys, model.updated_at)
        elif first:
            start = F.col(model.updated_at or model.observed_at) if model.updated_at or model.observed_at else F.current_timestamp()
            history = snapshot.initial(rows, start if model.initial_valid_from is None else F.coalesce(F.lit(model.initial_valid_from).cast(rows.select(start.alias("s")).schema["s"].dataType), start))
        elif kind == "check":
            observed = F.col(f"new.`{model.observed_at}`") if model.observed_at else F.current_timestamp()
            history = snapshot.current_check(known, rows, keys, check, observed, model.invalidate_hard_deletes)
        else:
            history = snapshot.current_timestamp(known, rows, keys, model.updated_at, model.invalidate_hard_deletes, F.current_timestamp())
        self.warehouse.replace_staged(model.name, history.withColumnsRenamed(names), lambda new: self._audit(model, new, result))

    # --- other commands ----------------------------------------------------------------------------

    def test(self, name: str, given: dict[tuple[str, str], DataFrame], expected: DataFrame, window: Interval | None = None) -> compare.TestVerdict:
        """A unit test: the model and the models between it and the given inputs run on those; nothing is written."""
        window = window or Interval(datetime(1900, 1, 1), datetime(2999, 12, 31))
        bounds = sql_literal(window.start), sql_literal(window.end)
        built: dict[str, str] = {}

        def relation(kind: str, ref: str) -> str:
            view = f"test_{kind}_{ref}"
            if kind in ("udf", "table_fn"):
                return self._name(kind, ref)
            if (kind, ref) in given:
                given[kind, ref].createOrReplaceTempView(view)
            elif kind == "ref" and view not in built:
                built[view] = ref
                model = self.project.models[ref]
                self.spark.sql(self.project.render(model, relation, bounds)).createOrReplaceTempView(view)
            elif kind != "ref":
                raise ProjectError(f"the test of {name} gives no {kind} {ref}")
            return f"`{view}`"

        actual = self.spark.sql(self.project.render(self.project.models[name], relation, bounds))
        return compare.compare_expected(actual, expected)

    def query(self, sql: str, limit: int = 20) -> DataFrame:
        return self.spark.sql(sql).limit(limit)

    def migrate(self, model: Model) -> bool:
        """Give a renamed model's relation its new name, once; the old name may stay as a view."""
        old = model.migrate_from
        if not old or not self.warehouse.exists(old) or self.warehouse.exists(model.name):
            return False
        self.warehouse.rename(old, model.name)
        if model.old_name_view:
            self.warehouse.create_view(old, f"SELECT * FROM {self.warehouse.name(model.name)}")
        return True
