"""Sorting, limits, top-k, deterministic samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.sampling import hash_sample
from millrace.queries.base import QuerySet, tables_of

QUERIES = QuerySet()

QUERIES.sql("q_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25", ("orders",))
QUERIES.sql("q_limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20", ("customer",))
QUERIES.sql("q_order_by", "SELECT n_name, ROW_NUMBER() OVER (ORDER BY n_regionkey DESC NULLS LAST, n_name ASC NULLS FIRST) AS place FROM nation", ("nation",))
_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 2000"
for _name, _operator in (
    ("q_union_all", "UNION ALL"),
    ("q_union", "UNION"),
    ("q_except", "EXCEPT"),
    ("q_except_all", "EXCEPT ALL"),
    ("q_intersect", "INTERSECT"),
    ("q_intersect_all", "INTERSECT ALL"),
):
    QUERIES.sql(_name, f"{_A} {_operator} {_B}", ("customer", "supplier"))
QUERIES.sql("q_set_precedence", f"{_A} UNION {_B} INTERSECT SELECT n_nationkey AS k FROM nation WHERE n_regionkey < 3", ("customer", "supplier", "nation"))


@QUERIES.frame(
    "q_sample_md5",
    """
    SELECT o_orderkey, o_custkey FROM orders
    ORDER BY md5(concat_ws('|', '7', CAST(length(CAST(o_orderkey AS VARCHAR)) AS VARCHAR), CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 25
    """,
)
def sample_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = tables_of(spark, sf_dir, "orders")
    return hash_sample(orders, ["o_orderkey"], seed=7, rows=25).select("o_orderkey", "o_custkey")
