"""Cursor scalars, grains, durations and half-open intervals. Pure Python; nothing here touches data."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

Scalar = int | date | datetime
GRAINS = ("second", "minute", "hour", "day", "month", "year")


@dataclass(frozen=True)
class Duration:
    """Months and days follow the calendar, seconds the clock."""

    months: int = 0
    days: int = 0
    seconds: int = 0

    def __neg__(self) -> Duration:
        return Duration(-self.months, -self.days, -self.seconds)


_UNITS = {"y": ("months", 12), "mo": ("months", 1), "w": ("days", 7), "d": ("days", 1), "h": ("seconds", 3600), "m": ("seconds", 60), "s": ("seconds", 1)}


def parse_duration(text: str) -> Duration:
    """A duration such as 14d, 6h, 1mo or 1d12h."""
    parts = re.findall(r"(\d+)(mo|[ywdhms])", text.strip().lower())
    if not parts or "".join(n + u for n, u in parts) != text.strip().lower():
        raise ValueError(f"not a duration: {text!r}")
    total = {"months": 0, "days": 0, "seconds": 0}
    for number, unit in parts:
        field, scale = _UNITS[unit]
        total[field] += int(number) * scale
    return Duration(**total)


def _moment(value: Scalar) -> datetime:
    return value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)


def _as(value: datetime, like: Scalar) -> Scalar:
    return value if isinstance(like, datetime) else value.date()


def _months(value: datetime, months: int, day: int | None = None) -> datetime:
    index = value.year * 12 + value.month - 1 + months
    year, month = divmod(index, 12)
    last = (datetime(year + month // 11, (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return value.replace(year=year, month=month + 1, day=min(day or value.day, last))


def shift(value: Scalar, by: Duration) -> Scalar:
    """A moment moved by a duration; an integer moves by the duration's seconds."""
    if isinstance(value, int):
        if by.months or by.days:
            raise ValueError("an integer cursor moves by whole steps, not by days or months")
        return value + by.seconds
    moved = _months(_moment(value), by.months) + timedelta(days=by.days, seconds=by.seconds)
    return _as(moved, value)


def floor_to(value: Scalar, grain: str) -> Scalar:
    """The start of the grain that a moment lies in; integers are their own start."""
    if isinstance(value, int):
        return value
    moment = _moment(value).replace(microsecond=0)
    at = GRAINS.index(grain)
    parts = ("second", "minute", "hour")[:at] if at <= 3 else ("second", "minute", "hour")
    moment = moment.replace(**{p: 0 for p in parts})
    if at >= 4:
        moment = moment.replace(day=1)
    if at >= 5:
        moment = moment.replace(month=1)
    return _as(moment, value)


def advance(value: Scalar, grain: str | None, steps: int = 1) -> Scalar:
    """The moment `steps` grains later. Months and years go from the first day of theirs."""
    if isinstance(value, int):
        return value + steps
    grain = grain or "second"
    if grain in ("month", "year"):
        return _as(_months(_moment(value), steps * (12 if grain == "year" else 1), day=1), value)
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[grain]
    return _as(_moment(value) + timedelta(seconds=seconds * steps), value)


def exclusive_end(value: Scalar) -> Scalar:
    """The least end that still includes a value: one more, one microsecond or one day later."""
    if isinstance(value, datetime):
        return value + timedelta(microseconds=1)
    return value + 1 if isinstance(value, int) else value + timedelta(days=1)


@dataclass(frozen=True, order=True)
class Interval:
    """[start, end)."""

    start: Scalar
    end: Scalar

    @property
    def empty(self) -> bool:
        return not self.start < self.end


def observed_partition(value: Scalar, grain: str | None) -> Interval:
    """The partition that a value was seen in."""
    start = floor_to(value, grain or "second")
    return Interval(start, advance(start, grain))


def clamp(interval: Interval, within: Interval) -> Interval | None:
    """The common part, or None."""
    found = Interval(max(interval.start, within.start), min(interval.end, within.end))
    return None if found.empty else found


def merge_intervals(intervals: Iterable[Interval]) -> list[Interval]:
    """Intervals in order, with those that overlap or touch made one."""
    merged: list[Interval] = []
    for one in sorted(x for x in intervals if not x.empty):
        if merged and one.start <= merged[-1].end:
            merged[-1] = Interval(merged[-1].start, max(merged[-1].end, one.end))
        else:
            merged.append(one)
    return merged


def subtract(interval: Interval, taken: Iterable[Interval]) -> list[Interval]:
    """The parts of an interval that none of the others covers."""
    left, at = [], interval.start
    for one in merge_intervals(taken):
        if one.end <= at or one.start >= interval.end:
            continue
        if one.start > at:
            left.append(Interval(at, one.start))
        at = max(at, one.end)
    if at < interval.end:
        left.append(Interval(at, interval.end))
    return left


def split(interval: Interval, grain: str | None, step: int = 1) -> list[Interval]:
    """Parts of `step` grains each; the last may be short."""
    parts, at = [], interval.start
    while at < interval.end:
        after = min(advance(at, grain, step), interval.end)
        parts.append(Interval(at, after))
        at = after
    return parts


def raw_bounds(target_max: Scalar | None, upstream: list[tuple[Scalar | None, Scalar | None]], grain: str | None, mode: str = "all") -> Interval | None:
    """The window that the inputs' (min, max) open: it ends with the partition of the least maximum (`all`) or
    of the greatest (`any`), and starts at the target's maximum, or else at the least minimum."""
    seen = [(low, high) for low, high in upstream if high is not None]
    if not seen or (mode == "all" and len(seen) < len(upstream)):
        return None
    ends = [observed_partition(high, grain).end for _, high in seen]
    start = target_max if target_max is not None else min(low for low, _ in seen)
    return Interval(start, min(ends) if mode == "all" else max(ends))


def replay_start(window: Interval, lookback: Duration | None = None, backfill: Duration | None = None, floor: Scalar | None = None) -> Scalar:
    """Where to read from: the end less a backfill's span, or the start less the lookback; never before the floor."""
    start = shift(window.end, -backfill) if backfill else shift(window.start, -lookback) if lookback else window.start
    return start if floor is None else max(floor, start)


def safety_horizon(clock: Scalar, distance: Duration, grain: str) -> Scalar:
    """The latest end that a cursor may claim: the clock plus a distance, floored to the grain."""
    return floor_to(shift(clock, distance), grain)


# --- microbatch coverage ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Completion:
    """A batch that was done; `sequence` tells the later of two. `known_missing` marks one that found nothing to do."""

    interval: Interval
    sequence: int
    known_missing: bool = False


@dataclass(frozen=True)
class Segment:
    interval: Interval
    state: str  # "complete", "known missing" or "unaccounted"


def project_coverage(expected: Interval, completions: Iterable[Completion]) -> tuple[list[Segment], Scalar]:
    """Segments of the expected interval, each with what the latest completion over it says, and the frontier
    up to which all is complete."""
    inside = [(c, part) for c in completions if (part := clamp(c.interval, expected))]
    edges = sorted({expected.start, expected.end, *(x for _, p in inside for x in (p.start, p.end))})
    segments: list[Segment] = []
    for start, end in zip(edges, edges[1:], strict=False):
        over = [c for c, p in inside if p.start <= start and end <= p.end]
        last = max(over, key=lambda c: c.sequence, default=None)
        state = "unaccounted" if last is None else "known missing" if last.known_missing else "complete"
        if segments and segments[-1].state == state:
            segments[-1] = Segment(Interval(segments[-1].interval.start, end), state)
        else:
            segments.append(Segment(Interval(start, end), state))
    frontier = expected.start
    for segment in segments:
        if segment.state != "complete":
            break
        frontier = segment.interval.end
    return segments, frontier


def replay_state(required: Interval, required_at: int, completions: Iterable[Completion], superseded_by: int | None = None) -> str:
    """What became of a demand to replay: superseded, incomplete, complete (but by a batch of unknown order) or verified."""
    if superseded_by is not None and superseded_by > required_at:
        return "superseded"
    every = list(completions)
    later = [c.interval for c in every if c.sequence > required_at and not c.known_missing]
    if not subtract(required, later):
        return "verified"
    unknown = [c.interval for c in every if c.sequence == required_at]
    return "complete unknown" if not subtract(required, later + unknown) else "incomplete"


def gaps_to_run(segments: list[Segment], policy: str) -> list[Interval]:
    """The intervals that a gap policy runs: none (`synthesize` declares them done), the known-missing ones
    (`recover_empty`) or all (`recover_all`)."""
    states = {"synthesize": (), "recover_empty": ("known missing",), "recover_all": ("known missing", "unaccounted")}[policy]
    return [s.interval for s in segments if s.state in states]
