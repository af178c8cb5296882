"""Grouped aggregation: plain, conditional, ordered-set, and over several groupings at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.queries.base import QuerySet, tables_of

QUERIES = QuerySet()

QUERIES.sql(
    "q_daily_revenue",
    """
    SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS order_day,
           COUNT(DISTINCT o_orderkey) AS n_orders,
           CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
           CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue_cents,
           CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / COUNT(DISTINCT o_orderkey) AS cents_per_order
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY CAST(o_orderdate AS DATE)
    """,
    ("orders", "lineitem"),
)
QUERIES.sql(
    "q_group_aggregates",
    """
    SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
           ROUND(AVG(l_discount), 6) AS mean_discount, MIN(l_extendedprice) AS least, MAX(l_extendedprice) AS most
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus
    """,
    ("lineitem",),
)
QUERIES.sql("q_count_distinct", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus", ("orders",))
QUERIES.sql("q_global_aggregate", "SELECT COUNT(*) AS n, MIN(o_totalprice) AS least, MAX(o_totalprice) AS most, COUNT(DISTINCT o_custkey) AS customers FROM orders", ("orders",))
QUERIES.sql("q_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15", ("orders",))
QUERIES.sql(
    "q_countif_bool",
    """
    SELECT user_id, COUNT_IF(event_type = 'purchase') AS purchases, COUNT(*) FILTER (WHERE value > 50) AS large,
           CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
           BOOL_OR(event_type = 'error') AS any_error, BOOL_AND(value > 0) AS all_positive
    FROM events GROUP BY user_id
    """,
    ("events",),
)
QUERIES.sql(
    "q_minby_maxby",
    """
    SELECT o_custkey, MIN_BY(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order, MAX_BY(o_orderkey, struct(o_orderdate, o_orderkey)) AS last_order,
           ANY_VALUE(o_custkey) AS any_customer
    FROM orders GROUP BY o_custkey
    """,
    ("orders",),
    """
    SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order,
           ANY_VALUE(o_custkey) AS any_customer
    FROM orders GROUP BY o_custkey
    """,
)
QUERIES.sql(
    "q_percentiles",
    """
    SELECT o_orderpriority, ROUND(MEDIAN(o_totalprice), 4) AS middle,
           ROUND(PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90,
           PERCENTILE_DISC(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS q1
    FROM orders GROUP BY o_orderpriority
    """,
    ("orders",),
)
QUERIES.sql(
    "q_mode",
    # Ties go to the least value, so that the result is fixed.
    """
    SELECT o_custkey, MIN_BY(o_orderpriority, struct(-n, o_orderpriority)) AS usual
    FROM (SELECT o_custkey, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority) t GROUP BY o_custkey
    """,
    ("orders",),
    """
    SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS usual
    FROM (SELECT o_custkey, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority) t GROUP BY o_custkey
    """,
)
QUERIES.sql(
    "q_listagg",
    """
    SELECT user_id, LISTAGG(DISTINCT event_type, '|') WITHIN GROUP (ORDER BY event_type) AS kinds,
           ARRAY_JOIN(TRANSFORM(ARRAY_SORT(COLLECT_LIST(event_id)), x -> CAST(x AS STRING)), ',') AS ids
    FROM events GROUP BY user_id
    """,
    ("events",),
    "SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id",
)
QUERIES.sql(
    "q_object_agg",
    """
    SELECT user_id, TO_JSON(MAP_FROM_ENTRIES(ARRAY_SORT(COLLECT_LIST(struct(event_type, n))))) AS counts
    FROM (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY user_id, event_type) t GROUP BY user_id
    """,
    ("events",),
    """
    SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS counts
    FROM (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY user_id, event_type) t GROUP BY user_id
    """,
)
QUERIES.sql("q_stddev", "SELECT event_type, ROUND(STDDEV_SAMP(value), 6) AS deviation, ROUND(VAR_SAMP(value), 5) AS variance FROM events GROUP BY event_type", ("events",))
QUERIES.sql(
    "q_ratio_to_report",
    """
    SELECT l_returnflag, l_linestatus, n, ROUND(CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY l_returnflag), 8) AS share
    FROM (SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus) t
    """,
    ("lineitem",),
)
for _name, _grouping in (
    ("q_rollup", "ROLLUP (o_orderstatus, o_orderpriority)"),
    ("q_cube", "CUBE (o_orderstatus, o_orderpriority)"),
    ("q_grouping_sets", "GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))"),
):
    QUERIES.sql(
        _name,
        f"SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus) AS INT) AS g1, CAST(GROUPING(o_orderpriority) AS INT) AS g2, COUNT(*) AS n FROM orders GROUP BY {_grouping}",
        ("orders",),
    )
QUERIES.sql(
    "q_pivot",
    "SELECT * FROM (SELECT user_id, event_type, value FROM events) PIVOT (MAX(value) FOR event_type IN ('click' AS click, 'view' AS view_value, 'purchase' AS purchase))",
    ("events",),
    """
    SELECT user_id, MAX(value) FILTER (WHERE event_type = 'click') AS click, MAX(value) FILTER (WHERE event_type = 'view') AS view_value,
           MAX(value) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id
    """,
)
QUERIES.sql(
    "q_unpivot",
    "SELECT l_orderkey, l_linenumber, measure, amount FROM (SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0D) AS discount, NULLIF(l_tax, 0D) AS tax FROM lineitem) UNPIVOT (amount FOR measure IN (discount, tax))",
    ("lineitem",),
    "SELECT l_orderkey, l_linenumber, measure, amount FROM (SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0) AS discount, NULLIF(l_tax, 0) AS tax FROM lineitem) UNPIVOT (amount FOR measure IN (discount, tax))",
)


@QUERIES.frame("q_approx_distinct", "SELECT event_type, COUNT(DISTINCT user_id) BETWEEN 135 AND 165 AS near FROM events GROUP BY event_type")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch's estimate lies within a tenth of 150 users, as the exact count does."""
    (events,) = tables_of(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).between(135, 165).alias("near"))
