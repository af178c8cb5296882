"""Projection, filters and predicates."""

from __future__ import annotations

from millrace.queries.base import QuerySet

QUERIES = QuerySet()

QUERIES.sql(
    "q_cte_chain",
    # A sum of doubles depends on the order of the rows, and so does its rounding where the true sum ends in a half. Prices and
    # discounts of up to four decimals are summed as whole numbers; a group with any other value has the sum of its doubles.
    """
    WITH steps AS (SELECT *, RINT(l_extendedprice * 10000) AS price, RINT(l_discount * 10000) AS discount FROM lineitem),
         priced AS (
           SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net,
                  CASE WHEN price / 10000 = l_extendedprice AND discount / 10000 = l_discount AND ABS(price) < 1e12 AND ABS(discount) < 1e5
                       THEN CAST(price AS BIGINT) * (10000 - CAST(discount AS BIGINT)) END AS whole
           FROM steps
         ),
         totals AS (SELECT l_orderkey, SUM(net) AS net, CASE WHEN COUNT(whole) = COUNT(net) THEN TRY_SUM(whole) END AS whole FROM priced GROUP BY l_orderkey),
         summed AS (
           SELECT l_orderkey AS order_key, COALESCE(CAST(ROUND(CAST(whole AS DECIMAL(20, 0)) / 100000000) AS BIGINT), CAST(ROUND(net) AS BIGINT)) AS net
           FROM totals
         )
    SELECT order_key, net, net > 100000 AS large FROM summed
    """,
    ("lineitem",),
    """
    WITH priced AS (SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem),
         summed AS (SELECT l_orderkey AS order_key, CAST(ROUND(SUM(net)) AS BIGINT) AS net FROM priced GROUP BY l_orderkey)
    SELECT order_key, net, net > 100000 AS large FROM summed
    """,
)
QUERIES.sql("q_star_cte", "WITH n AS (SELECT * FROM nation) SELECT *, n_nationkey * 2 AS doubled FROM n", ("nation",))
QUERIES.sql("q_exclude", "SELECT * EXCEPT (c_name, c_acctbal) FROM customer", ("customer",), "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
QUERIES.sql("q_distinct", "SELECT DISTINCT p_brand, p_type FROM part", ("part",))
QUERIES.sql("q_filter_logic", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR NOT (o_orderpriority <> '1-URGENT' OR o_custkey % 2 = 0)", ("orders",))
QUERIES.sql("q_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_shipdate NOT BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00'", ("lineitem",))
QUERIES.sql("q_in_list", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND p_size NOT IN (1, 2, 3)", ("part",))
QUERIES.sql("q_not_in_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END FROM orders)", ("customer", "orders"))
QUERIES.sql("q_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", ("customer", "orders"))
QUERIES.sql("q_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')", ("customer", "orders"))
QUERIES.sql(
    "q_null_predicates",
    """
    SELECT event_id, flag IS NULL AS missing, flag IS DISTINCT FROM 'click' AS other, flag IS NOT DISTINCT FROM NULL AS nothing
    FROM (SELECT event_id, NULLIF(event_type, 'view') AS flag FROM events) t
    """,
    ("events",),
)
QUERIES.sql(
    "q_like_family",
    """
    SELECT p_partkey, p_name ILIKE '%RING' AS ring, p_name LIKE ANY ('red%', 'blue%') AS coloured, p_name RLIKE '^(?:[a-z]+ (widget|bolt))$' AS full_match
    FROM part
    """,
    ("part",),
    "SELECT p_partkey, p_name ILIKE '%RING' AS ring, (p_name LIKE 'red%' OR p_name LIKE 'blue%') AS coloured, regexp_full_match(p_name, '[a-z]+ (widget|bolt)') AS full_match FROM part",
)
QUERIES.sql(
    "q_conditionals",
    """
    SELECT o_orderkey, IF(o_totalprice > 250000, 'big', 'small') AS size, COALESCE(NULLIF(o_orderstatus, 'P'), 'pending') AS status,
           DECODE(o_orderstatus, 'O', 1, 'F', 2, 0) AS code, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END AS rank
    FROM orders
    """,
    ("orders",),
    """
    SELECT o_orderkey, IF(o_totalprice > 250000, 'big', 'small') AS size, COALESCE(NULLIF(o_orderstatus, 'P'), 'pending') AS status,
           CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS code, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END AS rank
    FROM orders
    """,
)
QUERIES.sql(
    "q_qualify_dedup",
    # The engine has no QUALIFY: the window is filtered one level up.
    "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rn FROM events) t WHERE rn = 1",
    ("events",),
    "SELECT user_id, event_id, event_type FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1",
)
QUERIES.sql(
    "q_casts",
    """
    SELECT p_partkey, CAST(p_retailprice AS INT) AS whole, TRY_CAST(p_name AS INT) AS bad, TRY_CAST(CAST(p_size AS STRING) AS BIGINT) AS good,
           CAST(TRY_CAST(REPLACE(p_brand, 'Brand#', '') AS DECIMAL(10, 2)) AS DOUBLE) AS brand
    FROM (SELECT p_partkey, FLOOR(p_retailprice) AS p_retailprice, p_name, p_size, p_brand FROM part) t
    """,
    ("part",),
)
