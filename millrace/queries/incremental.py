"""Cursor bounds, windows, microbatches, sessions and coverage."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import incremental as inc
from millrace.plans.intervals import Interval, floor_to, parse_duration, raw_bounds, replay_start
from millrace.queries.base import QuerySet, tables_of

QUERIES = QuerySet()
_HOURLY = "SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, COUNT(*) AS n, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2"


def _micros(column: str | Column) -> Column:
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def hourly(events: DataFrame) -> DataFrame:
    """Events and cents per hour and type."""
    grouped = events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


def _shown(frame: DataFrame) -> DataFrame:
    return frame.select(_micros("hour").alias("hour_us"), "event_type", "n", "cents")


@QUERIES.frame("q_cursor_bounds", "SELECT epoch_us(MIN(ts)) AS low_us, epoch_us(MAX(ts)) AS high_us, MIN(event_id) AS low_id, MAX(event_id) AS high_id FROM events")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables_of(spark, sf_dir, "events")
    return events.agg(_micros(F.min("ts")).alias("low_us"), _micros(F.max("ts")).alias("high_us"), F.min("event_id").alias("low_id"), F.max("event_id").alias("high_id"))


@QUERIES.frame("q_cursor_window", "SELECT event_id FROM events WHERE ts >= (SELECT date_trunc('day', MAX(ts)) - INTERVAL 6 DAYS FROM events) AND ts < (SELECT date_trunc('day', MAX(ts)) + INTERVAL 1 DAY FROM events)")
def cursor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven days by partition: bounds from the data, a backfill of seven days, and the filter on the scan."""
    (events,) = tables_of(spark, sf_dir, "events")
    window = raw_bounds(None, [inc.cursor_bounds(events, "ts")["ts"]], "day")
    window = Interval(replay_start(window, backfill=parse_duration("7d")), window.end)
    return events.where(inc.within("ts", window)).select("event_id")


@QUERIES.frame("q_microbatch_hourly", _HOURLY)
def microbatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in batches of ten days, each replacing its own range of the target: the same as at once."""
    (events,) = tables_of(spark, sf_dir, "events")
    parts: list[DataFrame] = []
    window = raw_bounds(None, [inc.cursor_bounds(events, "ts")["ts"]], "day")
    window = Interval(floor_to(window.start, "day"), window.end)
    inc.run_microbatches(lambda batch: hourly(events.where(inc.within("ts", batch))), window, "day", 10, lambda rows, _: parts.append(rows))
    return _shown(reduce(DataFrame.unionByName, parts))


@QUERIES.frame("q_lookback_late", _HOURLY)
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the events comes late, with the second run, which reads three days back and replaces them; those
    later than that would be lost, so the late ones here are of the last three days."""
    (events,) = tables_of(spark, sf_dir, "events")
    whole = raw_bounds(None, [inc.cursor_bounds(events, "ts")["ts"]], "day")
    cut = replay_start(whole, backfill=parse_duration("15d"))
    back = replay_start(Interval(cut, whole.end), lookback=parse_duration("3d"))
    late = (F.col("event_id") % 10 == 0) & (F.col("ts") >= inc.literal(back)) & (F.col("ts") < inc.literal(cut))
    first = hourly(events.where((F.col("ts") < inc.literal(cut)) & ~late))
    window = Interval(back, whole.end)
    second = hourly(events.where(inc.within("ts", window)))
    return _shown(inc.apply_increment(first, second, "delete_insert", window, "hour"))


@QUERIES.frame("q_tumbling", _HOURLY)
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables_of(spark, sf_dir, "events")
    grouped = events.groupBy(F.window(F.col("ts"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
    return grouped.select(_micros(F.col("w.start")).alias("hour_us"), "event_type", "n", "cents")


@QUERIES.frame(
    "q_sliding",
    "SELECT epoch_us(date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER))) AS start_us, COUNT(*) AS n FROM events, range(0, 3) g(k) GROUP BY 1",
)
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-hour windows that start every hour."""
    (events,) = tables_of(spark, sf_dir, "events")
    return events.groupBy(F.window(F.col("ts"), "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(_micros(F.col("w.start")).alias("start_us"), "n")


@QUERIES.frame(
    "q_sessions",
    """
    WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
         s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, COUNT(*) AS n, epoch_us(MIN(ts)) AS start_us, epoch_us(MAX(ts)) AS end_us, bool_or(event_type = 'purchase') AS bought FROM s GROUP BY user_id, session
    """,
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables_of(spark, sf_dir, "events")
    marked = inc.sessions(events, "user_id", "ts", 1800, "event_id")
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), _micros(F.min("ts")).alias("start_us"), _micros(F.max("ts")).alias("end_us"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))


@QUERIES.frame(
    "q_coverage_gaps",
    """
    WITH i AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts + INTERVAL 4 HOURS) AS e FROM events),
         f AS (SELECT *, CASE WHEN s <= MAX(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i),
         n AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT user_id, MIN(s) AS covered_from, MAX(e) AS covered_to FROM n GROUP BY user_id, island
    """,
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables_of(spark, sf_dir, "events")
    spans = events.select("user_id", _micros("ts").alias("covered_from"), (_micros("ts") + 4 * 3600 * 1_000_000).alias("covered_to"))
    return inc.islands(spans, "covered_from", "covered_to", "user_id")


@QUERIES.frame("q_unseen_events", "SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0")
def unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delivery that repeats itself and what is known brings each new event once."""
    (events,) = tables_of(spark, sf_dir, "events")
    return inc.unseen(events.unionByName(events.where("event_id % 2 = 0")), events.where("event_id % 3 = 0"), "event_id").select("event_id", "event_type")
