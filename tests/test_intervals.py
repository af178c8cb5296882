from __future__ import annotations

from datetime import date, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.plans import intervals as iv
from millrace.plans.intervals import Completion, Duration, Interval


@pytest.mark.parametrize(
    ("text", "expected"),
    [("14d", Duration(days=14)), ("6h", Duration(seconds=21600)), ("1mo", Duration(months=1)), ("1y2mo", Duration(months=14)), ("1d12h30m", Duration(days=1, seconds=45000)), ("2w", Duration(days=14))],
)
def test_durations(text, expected):
    assert iv.parse_duration(text) == expected


@pytest.mark.parametrize("text", ["", "d", "5", "5x", "1d junk"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        iv.parse_duration(text)


@pytest.mark.parametrize(
    ("value", "grain", "floor", "after"),
    [
        (datetime(2024, 2, 29, 13, 45, 59, 9), "second", datetime(2024, 2, 29, 13, 45, 59), datetime(2024, 2, 29, 13, 46)),
        (datetime(2024, 2, 29, 13, 45, 59), "hour", datetime(2024, 2, 29, 13), datetime(2024, 2, 29, 14)),
        (datetime(2024, 2, 29, 13, 45), "day", datetime(2024, 2, 29), datetime(2024, 3, 1)),
        (date(2024, 12, 31), "month", date(2024, 12, 1), date(2025, 1, 1)),
        (date(2024, 7, 4), "year", date(2024, 1, 1), date(2025, 1, 1)),
        (41, "day", 41, 42),
    ],
)
def test_partitions(value, grain, floor, after):
    assert iv.observed_partition(value, grain) == Interval(floor, after)


def test_window_without_a_grain_is_a_second_wide():
    window = iv.raw_bounds(datetime(2026, 1, 1), [(datetime(2025, 1, 1), datetime(2026, 1, 2))], None)
    assert window == Interval(datetime(2026, 1, 1), datetime(2026, 1, 2, 0, 0, 1))


def test_watermark_modes():
    inputs = [(1, 10), (3, 7)]
    assert iv.raw_bounds(None, inputs, None, "all") == Interval(1, 8)
    assert iv.raw_bounds(None, inputs, None, "any") == Interval(1, 11)
    assert iv.raw_bounds(None, [*inputs, (None, None)], None, "all") is None
    assert iv.raw_bounds(5, [*inputs, (None, None)], None, "any") == Interval(5, 11)


def test_replay_start():
    window = Interval(date(2024, 3, 10), date(2024, 3, 31))
    assert iv.replay_start(window, lookback=iv.parse_duration("3d")) == date(2024, 3, 7)
    assert iv.replay_start(window, backfill=iv.parse_duration("1mo")) == date(2024, 2, 29)
    assert iv.replay_start(window, lookback=iv.parse_duration("30d"), floor=date(2024, 3, 1)) == date(2024, 3, 1)


spans = st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=12).map(lambda x: [Interval(a, a + n) for a, n in x])


@given(spans)
def test_merging_keeps_every_point(parts):
    merged = iv.merge_intervals(parts)
    points = {p for i in parts for p in range(i.start, i.end)}
    assert {p for i in merged for p in range(i.start, i.end)} == points
    assert all(a.end < b.start for a, b in zip(merged, merged[1:], strict=False))


@given(spans)
def test_subtracting_leaves_the_rest(parts):
    left = iv.subtract(Interval(0, 70), parts)
    assert {p for i in left for p in range(i.start, i.end)} == set(range(70)) - {p for i in parts for p in range(i.start, i.end)}


@given(st.integers(0, 30), st.integers(0, 40), st.integers(1, 7))
def test_splitting_covers_without_overlap(start, length, step):
    parts = iv.split(Interval(start, start + length), None, step)
    assert [p for i in parts for p in range(i.start, i.end)] == list(range(start, start + length))


def test_coverage_and_replay():
    done = [Completion(Interval(0, 10), 1), Completion(Interval(20, 30), 2), Completion(Interval(10, 20), 3, True)]
    segments, frontier = iv.project_coverage(Interval(0, 40), done)
    assert [(s.interval.start, s.interval.end, s.state) for s in segments] == [(0, 10, "complete"), (10, 20, "known missing"), (20, 30, "complete"), (30, 40, "unaccounted")]
    assert frontier == 10
    assert iv.gaps_to_run(segments, "recover_empty") == [Interval(10, 20)]
    assert iv.gaps_to_run(segments, "recover_all") == [Interval(10, 20), Interval(30, 40)]
    assert iv.gaps_to_run(segments, "synthesize") == []
    assert iv.replay_state(Interval(20, 30), 1, done) == "verified"
    assert iv.replay_state(Interval(0, 30), 1, done) == "incomplete"
    assert iv.replay_state(Interval(0, 10), 1, done) == "complete unknown"
    assert iv.replay_state(Interval(0, 10), 1, done, superseded_by=2) == "superseded"
