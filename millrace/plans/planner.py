"""Decisions before a run: what changed, what to do about it, and why."""

from __future__ import annotations

from dataclasses import dataclass, replace

from millrace.plans.intervals import Interval, parse_duration, replay_start
from millrace.plans.project import Model, Project


@dataclass(frozen=True)
class State:
    """What is remembered of a model's last run."""

    query: str
    config: str
    schema: str
    functions: str = ""
    sources: str = ""


@dataclass(frozen=True)
class PlanEntry:
    model: str
    action: str  # create, replace, increment, replay, snapshot, skip
    reason: str
    window: Interval | None = None
    #: How far back from its end a replay reaches, where the window is known only when the model runs.
    backfill: str | None = None


def state_of(project: Project, model: Model, sources: str = "") -> State:
    used = sorted(n for kind, n in model.references() if kind in ("udf", "table_fn"))
    bodies = "".join(project.functions[n].version() for n in used)
    return State(model.query_hash(), model.config_hash(), model.schema_hash(), bodies, sources)


def change_kind(before: State | None, now: State) -> str:
    """What changed, the weightiest first: query, function, schema, config, or nothing."""
    if before is None:
        return "new"
    for kind, field in (("query", "query"), ("function", "functions"), ("schema", "schema"), ("config", "config")):
        if getattr(before, field) != getattr(now, field):
            return kind
    return "none"


def plan_model(project: Project, name: str, before: State | None, exists: bool, upstream_changed: bool = False, full_refresh: bool = False, window: Interval | None = None, sources: str = "") -> PlanEntry:
    """The action for one model. Incremental models go on from their window; a change of theirs is replayed
    as they say: forward (not at all), bounded by a duration, or in full."""
    model = project.models[name]
    now = state_of(project, model, sources)
    change = change_kind(before, now)
    fresh_sources = before is not None and before.sources != now.sources
    if model.materialized in ("incremental", "snapshot"):
        if not exists or before is None:
            return PlanEntry(name, "create", "first run", window)
        if full_refresh and (model.materialized != "snapshot" or model.snapshot_full_refresh):
            return PlanEntry(name, "replace", "full refresh", window)
        if model.materialized == "snapshot":
            return PlanEntry(name, "snapshot", "new observation")
        if change in ("query", "function", "schema") and model.replay_on_change == "full":
            return PlanEntry(name, "replace", f"{change} changed, full replay", window)
        if change in ("query", "function", "schema") and model.replay_on_change.startswith("bounded-"):
            backfill = model.replay_on_change.removeprefix("bounded-")
            if window is not None:
                start = replay_start(window, backfill=parse_duration(backfill))
                window = replace(window, start=min(start, window.start))
            return PlanEntry(name, "replay", f"{change} changed, bounded replay", window, backfill)
        if window is not None and model.lookback:
            window = replace(window, start=replay_start(window, lookback=parse_duration(model.lookback)))
        return PlanEntry(name, "increment", "new rows" if change == "none" else f"{change} changed, forward only", window)
    if not exists:
        return PlanEntry(name, "create", "first run")
    if full_refresh:
        return PlanEntry(name, "replace", "full refresh")
    if change not in ("none", "new"):
        return PlanEntry(name, "replace", f"{change} changed")
    if model.materialized == "table" and (upstream_changed or fresh_sources or before is None):
        return PlanEntry(name, "replace", "upstream changed" if upstream_changed else "source data changed" if fresh_sources else "no state")
    return PlanEntry(name, "skip", "unchanged")


def sources_seen(project: Project, sources: dict[str, str] | None) -> dict[str, str]:
    """For each model, the versions of the sources and seeds that it reads itself, as one text."""
    return {name: "|".join(f"{n}={sources[n]}" for n in sorted(reads) if sources and n in sources) for name, reads in project.graph().items()}


def plan(project: Project, states: dict[str, State], existing: set[str], chosen: set[str] | None = None, full_refresh: bool = False, sources: dict[str, str] | None = None) -> list[PlanEntry]:
    """Entries in build order; a model is told whether anything it reads is rebuilt or, through views that stay
    as they are, reads other data than before."""
    graph, seen, changed, entries = project.graph(), sources_seen(project, sources), set(), []
    for name in project.order(chosen):
        before = states.get(name)
        upstream = bool(graph[name] & changed)
        entry = plan_model(project, name, before, name in existing, upstream, full_refresh, sources=seen[name])
        moved = project.models[name].materialized == "view" and (upstream or (before is not None and before.sources != seen[name]))
        if entry.action != "skip" or moved:
            changed.add(name)
        entries.append(entry)
    return entries
