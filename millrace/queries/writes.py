"""Write strategies, schema evolution and snapshots, each as the table that results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import schema, snapshot, write
from millrace.queries.base import QuerySet, tables_of

QUERIES = QuerySet()

#: The orders of before 2000 are the target; the later ones, and a tenth of the others with a new price, the delta.
_TARGET = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00'"
_DELTA = "SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' OR o_orderkey % 10 = 0"
_OUT = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM "


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    (orders,) = tables_of(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    late = F.col("o_orderdate") >= F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    delta = rows.where(late | (F.col("o_orderkey") % 10 == 0)).withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    return rows.where(~late), delta


def _out(frame: DataFrame) -> DataFrame:
    return frame.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@QUERIES.frame("q_append", f"{_OUT} ({_TARGET} UNION ALL {_DELTA}) t")
def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(write.append(*_sides(spark, sf_dir)))


@QUERIES.frame("q_delete_insert_key", f"{_OUT} ({_TARGET} AND o_custkey NOT IN (SELECT o_custkey FROM ({_DELTA}) d) UNION ALL {_DELTA}) t")
def replaced_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, delta = _sides(spark, sf_dir)
    return _out(write.delete_insert_by_key(target, delta, ["o_custkey"]))


@QUERIES.frame(
    "q_delete_insert_range",
    f"{_OUT} ({_TARGET} AND NOT (o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-07-01 00:00:00') UNION ALL SELECT * FROM ({_DELTA}) d WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-07-01 00:00:00') t",
)
def replaced_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, delta = _sides(spark, sf_dir)
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("1998-01-01 00:00:00", "1998-07-01 00:00:00"))
    inside = delta.where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end))
    return _out(write.delete_insert_by_range(target, inside, "o_orderdate", start, end))


@QUERIES.frame("q_merge", f"{_OUT} ({_TARGET} AND o_orderkey NOT IN (SELECT o_orderkey FROM ({_DELTA}) d) UNION ALL {_DELTA}) t")
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, delta = _sides(spark, sf_dir)
    return _out(write.merge(target, delta, ["o_orderkey"]))


@QUERIES.frame(
    "q_merge_exclude",
    f"{_OUT} (SELECT coalesce(d.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(d.o_custkey, t.o_custkey) AS o_custkey, coalesce(t.o_orderstatus, d.o_orderstatus) AS o_orderstatus, coalesce(d.o_totalprice, t.o_totalprice) AS o_totalprice, coalesce(d.o_orderdate, t.o_orderdate) AS o_orderdate FROM ({_TARGET}) t FULL JOIN ({_DELTA}) d ON t.o_orderkey = d.o_orderkey) m",
)
def merged_but(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, delta = _sides(spark, sf_dir)
    return _out(write.merge(target, delta, ["o_orderkey"], exclude=["o_orderstatus"]))


@QUERIES.frame(
    "q_partition_rewrite",
    """
    WITH t AS (SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
         d AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, y FROM t WHERE o_orderkey % 100 = 0 AND y < 1998)
    SELECT * FROM t WHERE y IN (SELECT y FROM d) AND o_orderkey NOT IN (SELECT o_orderkey FROM d) UNION ALL SELECT * FROM d
    """,
)
def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = tables_of(spark, sf_dir, "orders")
    target = orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    delta = target.where("o_orderkey % 100 = 0 AND y < 1998").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return write.partition_rewrite(target, delta, ["o_orderkey"], "y")


@QUERIES.frame("q_type_enforce", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS BIGINT) AS p_size, CAST(CAST(p_retailprice AS DECIMAL(12, 1)) AS DOUBLE) AS p_retailprice, p_name FROM part")
def enforced(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = tables_of(spark, sf_dir, "part")
    cast = schema.enforce_types(part.select("p_partkey", "p_size", "p_retailprice", "p_name"), {"P_PARTKEY": "VARCHAR(20)", "p_size": "BIGINT", "p_retailprice": "NUMBER(12, 1)"})
    return cast.withColumn("p_retailprice", F.col("p_retailprice").cast("double"))


@QUERIES.frame(
    "q_schema_sync",
    "SELECT s_suppkey, CAST(CAST(s_nationkey AS BIGINT) AS BIGINT) AS s_nationkey, CAST(NULL AS VARCHAR) AS note FROM supplier UNION ALL SELECT s_suppkey + 100000, CAST(s_nationkey AS BIGINT), 'new' FROM supplier WHERE s_suppkey < 10",
)
def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta brings a column, lacks two, and has a wider type: the target follows."""
    (supplier,) = tables_of(spark, sf_dir, "supplier")
    delta = supplier.where("s_suppkey < 10").select((F.col("s_suppkey") + 100000).alias("s_suppkey"), F.col("s_nationkey").cast("bigint").alias("s_nationkey"), F.lit("new").alias("note"))
    actions = schema.schema_actions(dict(supplier.dtypes), dict(delta.dtypes), "sync_all_columns")
    return write.append(schema.evolve(supplier, actions), delta)


# --- snapshots -------------------------------------------------------------------------------------

_EVENTS = "SELECT user_id, event_type, value, ts FROM events"
_CUT = "TIMESTAMP '2024-01-16 00:00:00'"
_US = "epoch_us(valid_from) AS from_us, epoch_us(valid_to) AS to_us"
_CHANGED = "event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1"


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All events as observations, those before the cut, and those from it on."""
    (events,) = tables_of(spark, sf_dir, "events")
    rows = events.select("user_id", "event_type", "value", "ts")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return rows, rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)


def _micros(frame: DataFrame, *columns: str) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return frame.select(*columns, us(snapshot.FROM).alias("from_us"), us(snapshot.TO).alias("to_us"))


_CHECKED = f"""
SELECT user_id, event_type, {_US} FROM (
  SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to FROM (
    SELECT *, {_CHANGED} AS changed FROM ({_EVENTS}) e WINDOW w AS (PARTITION BY user_id ORDER BY ts)) c WHERE changed) v
"""


@QUERIES.frame("q_snap_hist_check", _CHECKED)
def hist_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micros(snapshot.historical_check(_history(spark, sf_dir)[0], ["user_id"], ["event_type"], "ts"), "user_id", "event_type")


@QUERIES.frame("q_snap_hist_check_apply", _CHECKED)
def hist_check_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history in two parts gives what it gives at once."""
    _, before, after = _history(spark, sf_dir)
    first = snapshot.historical_check(before, ["user_id"], ["event_type"], "ts")
    return _micros(snapshot.historical_check_apply(first, after, ["user_id"], ["event_type"], "ts"), "user_id", "event_type")


_STAMPED = f"""
SELECT user_id, {_US} FROM (
  SELECT user_id, stamp AS valid_from, lead(stamp) OVER (PARTITION BY user_id ORDER BY stamp) AS valid_to FROM (
    SELECT user_id, stamp, stamp IS DISTINCT FROM lag(stamp) OVER w OR row_number() OVER w = 1 AS changed
    FROM (SELECT user_id, date_trunc('day', ts) AS stamp, ts FROM events) e WINDOW w AS (PARTITION BY user_id ORDER BY ts)) c WHERE changed) v
"""


@QUERIES.frame("q_snap_hist_ts", _STAMPED)
def hist_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir)[0].withColumn("stamp", F.date_trunc("day", "ts"))
    return _micros(snapshot.historical_timestamp(rows, ["user_id"], "stamp", "ts"), "user_id")


@QUERIES.frame("q_snap_hist_ts_apply", _STAMPED)
def hist_ts_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, before, after = (x.withColumn("stamp", F.date_trunc("day", "ts")) for x in _history(spark, sf_dir))
    first = snapshot.historical_timestamp(before, ["user_id"], "stamp", "ts")
    return _micros(snapshot.historical_timestamp_apply(first, after, ["user_id"], "stamp", "ts"), "user_id")


_ALL_CHANGES = f"SELECT user_id, event_type, {_US} FROM (SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to FROM events) v"


@QUERIES.frame("q_snap_hist_changes", _ALL_CHANGES)
def hist_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micros(snapshot.historical_changes(_history(spark, sf_dir)[0], ["user_id"], "ts"), "user_id", "event_type")


@QUERIES.frame("q_snap_hist_changes_apply", _ALL_CHANGES)
def hist_changes_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, before, after = _history(spark, sf_dir)
    first = snapshot.historical_changes(before, ["user_id"], "ts")
    return _micros(snapshot.historical_changes_apply(first, after, ["user_id"], "ts"), "user_id", "event_type")


_LAST = "SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events WHERE %s GROUP BY user_id"
#: The state at the cut, and the one at the end; users divisible by 11 are not in the second.
_OLD, _NEW = _LAST % f"ts < {_CUT}", _LAST % "user_id % 11 <> 0"


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every, before, _ = _history(spark, sf_dir)
    last = lambda rows: rows.groupBy("user_id").agg(F.max_by("event_type", "ts").alias("event_type"), F.max("ts").alias("ts"))
    return last(before), last(every.where("user_id % 11 <> 0"))


def _snap_sql(changed: str, start: str, gone: str) -> str:
    return f"""
    WITH o AS ({_OLD}), n AS ({_NEW}), m AS (SELECT o.user_id AS ok, o.event_type AS oe, o.ts AS ot, n.user_id AS nk, n.event_type AS ne, n.ts AS nt FROM o FULL JOIN n ON o.user_id = n.user_id)
    SELECT user_id, event_type, {_US} FROM (
      SELECT ok AS user_id, oe AS event_type, ot AS valid_from, CASE WHEN nk IS NOT NULL AND ({changed}) THEN {start} {gone} END AS valid_to FROM m WHERE ok IS NOT NULL
      UNION ALL SELECT nk, ne, {start}, NULL FROM m WHERE nk IS NOT NULL AND (ok IS NULL OR {changed})) v
    """


_END = "TIMESTAMP '2024-02-01 00:00:00'"


@QUERIES.frame("q_snap_ts", _snap_sql("nt > ot", "nt", ""))
def snap_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _states(spark, sf_dir)
    return _micros(snapshot.current_timestamp(snapshot.initial(old, F.col("ts")), new, ["user_id"], "ts"), "user_id", "event_type")


@QUERIES.frame("q_snap_check", _snap_sql("ne IS DISTINCT FROM oe", _END, ""))
def snap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _states(spark, sf_dir)
    return _micros(snapshot.current_check(snapshot.initial(old, F.col("ts")), new, ["user_id"], ["event_type"], F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")), "user_id", "event_type")


@QUERIES.frame("q_snap_hard_delete", _snap_sql("nt > ot", "nt", f"WHEN nk IS NULL THEN {_END}"))
def snap_hard_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _states(spark, sf_dir)
    history = snapshot.initial(old, F.col("ts"))
    return _micros(snapshot.current_timestamp(history, new, ["user_id"], "ts", True, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")), "user_id", "event_type")
