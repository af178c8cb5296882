"""Window functions and frames."""

from __future__ import annotations

from millrace.queries.base import QuerySet

QUERIES = QuerySet()

QUERIES.sql(
    "q_rank_family",
    """
    SELECT o_orderkey, ROW_NUMBER() OVER w AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk,
           DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, NTILE(4) OVER w AS quarter,
           ROUND(PERCENT_RANK() OVER w, 8) AS pr, ROUND(CUME_DIST() OVER w, 8) AS cd
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    """,
    ("orders",),
)
QUERIES.sql(
    "q_lag_lead",
    """
    SELECT event_id, LAG(event_type) OVER w AS before, LEAD(event_type, 2, 'none') OVER w AS later, value - LAG(value, 1) OVER w AS change
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
    ("events",),
)
QUERIES.sql(
    "q_lag_ignore_nulls",
    "SELECT event_id, LAG(price) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_price FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS price FROM events) t",
    ("events",),
    "SELECT event_id, LAG(price IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_price FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS price FROM events) t",
)
QUERIES.sql(
    "q_first_last",
    """
    SELECT event_id, FIRST_VALUE(event_type) OVER w AS first_kind, LAST_VALUE(event_type) OVER w AS so_far,
           LAST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_kind,
           NTH_VALUE(event_type, 2) OVER w AS second_kind
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
    ("events",),
)
QUERIES.sql(
    "q_running_sum",
    "SELECT event_id, SUM(CAST(ROUND(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cents FROM events",
    ("events",),
    "SELECT event_id, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cents FROM events",
)
QUERIES.sql(
    "q_range_interval",
    "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS recent FROM events",
    ("events",),
)
QUERIES.sql(
    "q_partition_window",
    "SELECT p_partkey, MAX(p_retailprice) OVER (PARTITION BY p_brand) AS top, COUNT(*) OVER (PARTITION BY p_brand) AS n FROM part",
    ("part",),
)
QUERIES.sql(
    "q_moving_average",
    "SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events",
    ("events",),
)
QUERIES.sql(
    "q_topk_per_group",
    "SELECT l_suppkey, l_orderkey, l_linenumber, rn FROM (SELECT l_suppkey, l_orderkey, l_linenumber, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) t WHERE rn <= 3",
    ("lineitem",),
)
