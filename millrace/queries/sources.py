"""Sources, functions, and streams run to their end."""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import register_views
from millrace.plans.project import Function
from millrace.queries.base import QuerySet, tables_of
from millrace.sources import generators, loaders, seeds
from millrace.storage import new_path
from millrace.streaming import twins

QUERIES = QuerySet()

QUERIES.sql("q_expression_source", "SELECT order_key, cents FROM (SELECT o_orderkey AS order_key, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderstatus = 'F') payments WHERE cents > 40000000", ("orders",))
QUERIES.sql("q_values", "SELECT * FROM (VALUES (1, 'a', CAST(NULL AS INT)), (2, 'b', 3)) t(id, name, n)", ())


@QUERIES.frame("q_generator", "SELECT CAST(i AS BIGINT) AS n, CAST(i * i AS BIGINT) AS square FROM range(1000) g(i)")
def generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.row_numbers(spark, 1000).withColumn("square", F.col("n") * F.col("n"))


@QUERIES.frame("q_date_spine", "SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM range(DATE '2024-01-01', DATE '2025-01-01', INTERVAL 1 DAY) g(d)")
def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.date_spine(spark, date(2024, 1, 1), date(2025, 1, 1)).select(F.col("day").cast("string").alias("day"))


@QUERIES.frame("q_seed_nulls", "SELECT * FROM (VALUES (1, 'plain', 'x'), (2, NULL, 'N/A'), (3, 'unknown', NULL), (4, 'a, \"b\"', 'y')) t(id, name, note)")
def seed_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-column missing values of a seed file."""
    settings = seeds.SeedSettings(na_values={"name": ("N/A",), "note": ("unknown",)})
    path = new_path(spark, "seed")
    lines = ["id,name,note", "1,plain,x", "2,N/A,N/A", "3,unknown,", '4,"a, ""b""",y']
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return seeds.read_seed(spark, path, {"id": "INT", "name": "VARCHAR", "note": "VARCHAR"}, settings)


@QUERIES.frame("q_loader_evolution", "SELECT * FROM (VALUES (1, 'free', NULL), (2, 'pro', 7.5), (3, 'team', 9.0)) t(customer_id, plan_name, price)")
def loader_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second load merges, and brings a column."""
    first = loaders.stage(spark, [{"customer_id": 1, "plan_name": "free"}, {"customer_id": 2, "plan_name": "free"}])
    second = loaders.stage(spark, [{"customer_id": 2, "plan_name": "pro", "price": 7.5}, {"customer_id": 3, "plan_name": "team", "price": 9}])
    return loaders.load(loaders.load(None, first, "table"), second, "merge", keys=["customer_id"])


@QUERIES.frame("q_loader_delete_insert_whole", "SELECT event_id, CASE WHEN event_id BETWEEN 50 AND 99 THEN 'new' ELSE event_type END AS event_type FROM events")
def loader_delete_insert_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged rows replace a range inside the whole table."""
    (events,) = tables_of(spark, sf_dir, "events")
    staged = loaders.stage(spark, ({"event_id": i, "event_type": "new"} for i in range(50, 100)))
    return loaders.load(events.select("event_id", "event_type"), staged, "delete_insert", cursor="event_id")


# --- functions -------------------------------------------------------------------------------------


@QUERIES.frame("q_udf_sql", "SELECT p_partkey, upper(split_part(p_name, ' ', 1)) || '-' || p_size AS family FROM part")
def udf_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ["part"])
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION family_of(name STRING, size INT) RETURNS STRING RETURN CONCAT(UPPER(SPLIT_PART(name, ' ', 1)), '-', size)")
    return spark.sql("SELECT p_partkey, family_of(p_name, p_size) AS family FROM part")


@QUERIES.frame("q_udf_py", "SELECT p_partkey, reverse(p_name) || '!' AS shout FROM part")
def udf_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function declared in Python, as a project declares it, and used in SQL."""
    register_views(spark, sf_dir, ["part"])
    Function("shout", "name STRING", "string", python=lambda names: names.str[::-1] + "!").register(spark)
    return spark.sql("SELECT p_partkey, shout(p_name) AS shout FROM part")


@QUERIES.frame("q_udaf", "SELECT p_brand, CAST(MAX(p_size) - MIN(p_size) AS BIGINT) AS spread FROM part GROUP BY p_brand")
def udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = tables_of(spark, sf_dir, "part")

    @F.pandas_udf("bigint")
    def spread(sizes: pd.Series) -> int:
        return int(sizes.max() - sizes.min())

    return part.groupBy("p_brand").agg(spread("p_size").alias("spread"))


@QUERIES.frame("q_table_fn", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 450000")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ["orders"])
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION large_orders(status STRING, least DOUBLE) RETURNS TABLE (o_orderkey BIGINT, o_totalprice DOUBLE) RETURN SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = status AND o_totalprice > least")
    return spark.sql("SELECT * FROM large_orders('F', 450000D)")


# --- streams ---------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, build, columns, complete: bool = True) -> DataFrame:
    """Run a stream over the events to its end and read what it wrote. Every batch has a folder of its number,
    so a batch that is repeated after a failure replaces itself."""
    (events,) = tables_of(spark, sf_dir, "events")
    out, numbers = new_path(spark, "stream-out"), []

    def keep(batch: DataFrame, number: int) -> None:
        columns(batch).write.mode("overwrite").parquet(f"{out}/{number}")
        numbers.append(number)

    stream = twins.read_stream(spark, f"{sf_dir}/event[s].parquet", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    twins.run_to_end(build(stream), new_path(spark, "stream-state"), keep, mode="complete" if complete else "append")
    return spark.read.parquet(*(f"{out}/{n}" for n in ([max(numbers)] if complete else sorted(set(numbers)))))


def _tumbled(stream: DataFrame) -> DataFrame:
    return twins.tumbling(stream, "ts", "6 hours", "1 day", "event_type")


def _span(spark: SparkSession, sf_dir: str) -> str:
    """A lateness longer than the events' times span, so that none is behind the watermark in whatever order files come."""
    (events,) = tables_of(spark, sf_dir, "events")
    low, high = events.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).agg(F.min("s"), F.max("s")).first()
    return f"{(high or 0) - (low or 0) + 2} seconds"


def _sessioned(stream: DataFrame, late: str) -> DataFrame:
    return twins.session_counts(stream, "ts", "30 minutes", late, "user_id")


def _deduplicated(stream: DataFrame, late: str) -> DataFrame:
    return twins.deduplicated(stream.union(stream), "ts", late, "event_id")


@QUERIES.frame("q_stream_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01 00:00:00')) AS start_us, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, _tumbled, lambda b: b.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n"))


@QUERIES.frame(
    "q_stream_session",
    """
    WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
         s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, epoch_us(MIN(ts)) AS start_us, COUNT(*) AS n FROM s GROUP BY user_id, session
    """,
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = _span(spark, sf_dir)
    return _streamed(spark, sf_dir, lambda s: _sessioned(s, late), lambda b: b.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n"))


@QUERIES.frame("q_stream_dedup", "SELECT event_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is delivered twice and kept once."""
    late = _span(spark, sf_dir)
    return _streamed(spark, sf_dir, lambda s: _deduplicated(s, late), lambda b: b.select("event_id"), complete=False)
