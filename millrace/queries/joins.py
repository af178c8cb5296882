"""Joins of every kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import register_views
from millrace.operators.joins import asof_join, hierarchy, range_join, recursion
from millrace.queries.base import QuerySet, tables_of

QUERIES = QuerySet()

QUERIES.sql("q_join_inner", "SELECT o_orderkey, l_linenumber, o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey", ("orders", "lineitem"))
QUERIES.sql("q_join_constant", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND c_mktsegment = 'MACHINERY'", ("customer", "orders"))
QUERIES.sql("q_join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000", ("customer", "orders"))
QUERIES.sql("q_join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 450000", ("customer", "orders"))
QUERIES.sql(
    "q_join_full",
    """
    SELECT COALESCE(c.k, s.k) AS nation, c.n AS customers, s.n AS suppliers
    FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY c_nationkey) c
    FULL OUTER JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON c.k = s.k
    """,
    ("customer", "supplier"),
)
QUERIES.sql("q_join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", ("region", "nation"))
QUERIES.sql("q_join_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", ("customer", "orders"))
QUERIES.sql("q_join_semi_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)", ("part", "lineitem"))
QUERIES.sql("q_join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O'", ("customer", "orders"), "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O'")
QUERIES.sql("q_join_self", "SELECT a.n_name AS name, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", ("nation",))
QUERIES.sql(
    "q_join_theta",
    "SELECT a.event_id AS viewed, b.event_id AS bought FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND a.value <> b.value AND b.value - a.value > 60",
    ("events",),
)
QUERIES.sql(
    "q_join_band",
    "SELECT a.event_id AS clicked, b.event_id AS bought FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 30 MINUTES WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
    ("events",),
)
QUERIES.sql(
    "q_join_computed_key",
    "SELECT d.order_day, COUNT(*) AS n FROM (SELECT DISTINCT CAST(YEAR(o_orderdate) AS STRING) AS order_day FROM orders) d JOIN orders o ON d.order_day = CAST(YEAR(o.o_orderdate) AS STRING) GROUP BY d.order_day",
    ("orders",),
)

_ASOF = """
SELECT l.event_id, r.event_id AS purchase_id, r.value AS price
FROM (SELECT * FROM events WHERE event_type = 'error') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts
"""


def _asof_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    (events,) = tables_of(spark, sf_dir, "events")
    right = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("price"))
    return events.where("event_type = 'error'").select("event_id", "user_id", "ts"), right


@QUERIES.frame("q_asof", _ASOF)
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _asof_sides(spark, sf_dir)
    return asof_join(left, right, ["user_id"], "ts", "ts", ["purchase_id", "price"]).select("event_id", "purchase_id", "price")


@QUERIES.frame("q_asof_bucketed", _ASOF)
def asof_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with every user's rows cut into days, as a hot key needs."""
    left, right = _asof_sides(spark, sf_dir)
    return asof_join(left, right, ["user_id"], "ts", "ts", ["purchase_id", "price"], F.date_trunc("day", "_time")).select("event_id", "purchase_id", "price")


@QUERIES.frame(
    "q_range_join",
    """
    SELECT p_partkey, s_suppkey FROM part JOIN (SELECT s_suppkey, s_acctbal / 10 AS low, s_acctbal / 10 + 25 AS high FROM supplier) s
    ON p_retailprice >= low AND p_retailprice < high
    """,
)
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier = tables_of(spark, sf_dir, "part", "supplier")
    spans = supplier.select("s_suppkey", (F.col("s_acctbal") / 10).alias("low"), (F.col("s_acctbal") / 10 + 25).alias("high"))
    return range_join(part.select("p_partkey", "p_retailprice"), spans, "p_retailprice", "low", "high", 25.0).select("p_partkey", "s_suppkey")


_TREE = "SELECT p_partkey AS id, CASE WHEN p_partkey < 3 THEN NULL ELSE p_partkey // 3 END AS parent FROM part"
_WALK = """
WITH RECURSIVE tree AS (%s), walk AS (
  SELECT id, 1 AS level, id AS root, '/' || CAST(id AS VARCHAR) AS path FROM tree WHERE parent IS NULL
  UNION ALL
  SELECT t.id, w.level + 1, w.root, w.path || '/' || CAST(t.id AS VARCHAR) FROM walk w JOIN tree t ON t.parent = w.id
) SELECT id, level, root, path FROM walk
"""


@QUERIES.frame("q_hierarchy", _WALK % _TREE)
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = tables_of(spark, sf_dir, "part")
    edges = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") >= 3, F.floor(F.col("p_partkey") / 3)).alias("parent"))
    return hierarchy(edges, "id", "parent")


@QUERIES.frame("q_recursive_cte", _WALK % _TREE)
def recursive_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("part",))
    return recursion(spark, (_WALK % _TREE.replace("p_partkey // 3", "p_partkey DIV 3")).replace("VARCHAR", "STRING"))


QUERIES.sql("q_lateral_flatten", "SELECT vec_id, i, ROUND(CAST(x AS DOUBLE), 6) AS x FROM embeddings LATERAL VIEW OUTER POSEXPLODE(SLICE(embedding, 1, 4)) AS i, x", ("embeddings",), "SELECT vec_id, CAST(i AS INTEGER) - 1 AS i, ROUND(CAST(embedding[i] AS DOUBLE), 6) AS x FROM embeddings, range(1, 5) g(i)")
QUERIES.sql("q_lateral_flatten_whole", "SELECT vec_id, i, ROUND(CAST(x AS DOUBLE), 6) AS x FROM embeddings LATERAL VIEW OUTER POSEXPLODE(embedding) AS i, x", ("embeddings",), "SELECT vec_id, CAST(i AS INTEGER) - 1 AS i, ROUND(CAST(embedding[i] AS DOUBLE), 6) AS x FROM embeddings LEFT JOIN LATERAL (SELECT UNNEST(range(1, len(embedding) + 1)) AS i) g ON TRUE")
QUERIES.sql("q_split_to_table", "SELECT p_partkey, i, word FROM part LATERAL VIEW POSEXPLODE(SPLIT(p_name, ' ')) AS i, word", ("part",), "SELECT p_partkey, CAST(i AS INTEGER) - 1 AS i, split_part(p_name, ' ', i) AS word FROM part, range(1, 10) g(i) WHERE i <= len(string_split(p_name, ' '))")
QUERIES.sql(
    "q_lateral_subquery",
    "SELECT n_name, t.c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t",
    ("nation", "customer"),
)
