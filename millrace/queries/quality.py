"""Audits, measurements, comparisons, contracts and freshness."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import compare, quality, schema
from millrace.queries.base import QuerySet, tables_of
from millrace.sources import freshness

QUERIES = QuerySet()


@QUERIES.frame("q_audit_not_null", "SELECT event_id FROM (SELECT event_id, NULLIF(event_type, 'error') AS kind FROM events) t WHERE kind IS NULL")
def audit_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables_of(spark, sf_dir, "events")
    return quality.not_null(events.withColumn("kind", F.expr("NULLIF(event_type, 'error')")), "kind").select("event_id")


@QUERIES.frame("q_audit_unique", "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) > 1")
def audit_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lines,) = tables_of(spark, sf_dir, "lineitem")
    return quality.unique(lines, "l_orderkey", "l_linenumber")


@QUERIES.frame("q_audit_accepted", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def audit_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = tables_of(spark, sf_dir, "orders")
    return quality.accepted_values(orders, "o_orderstatus", ["O", "F"]).select("o_orderkey", "o_orderstatus")


@QUERIES.frame("q_audit_relationships", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def audit_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = tables_of(spark, sf_dir, "lineitem", "part")
    return quality.relationships(lines, "l_partkey", part.where("p_size > 5"), "p_partkey").select("l_orderkey", "l_linenumber")


@QUERIES.frame("q_audit_custom", "SELECT c_custkey FROM customer WHERE c_acctbal < 100")
def audit_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    (customer,) = tables_of(spark, sf_dir, "customer")
    customer.createOrReplaceTempView("customer")
    return quality.custom(spark, "SELECT c_custkey FROM @relation WHERE @column < @least", "customer", column="c_acctbal", least=100)


@QUERIES.frame(
    "q_measurement",
    """
    SELECT event_type, CASE WHEN COUNT(*) < 5 THEN 'insufficient' WHEN AVG(value) < 40 THEN 'error' WHEN AVG(value) < 50 THEN 'warn' ELSE 'pass' END AS status
    FROM events GROUP BY event_type
    """,
)
def measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables_of(spark, sf_dir, "events")
    measured = events.groupBy("event_type").agg(F.avg("value").alias("value"), F.count("value").alias("sample_count"))
    limits = quality.Thresholds(warn_below=50, error_below=40, least_samples=5)
    return measured.select("event_type", quality.judged(F.col("value"), F.col("sample_count"), limits).alias("status"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The parts, and the parts with some gone, some new and some prices changed."""
    (part,) = tables_of(spark, sf_dir, "part")
    old = part.select("p_partkey", "p_name", "p_size", "p_retailprice")
    changed = F.when(F.col("p_partkey") % 50 == 0, F.col("p_retailprice") + 5).when(F.col("p_partkey") % 50 == 1, F.col("p_retailprice") + 0.4).otherwise(F.col("p_retailprice"))
    new = old.where("p_partkey % 20 <> 3").withColumn("p_retailprice", changed)
    return old, new.unionByName(old.where("p_partkey < 10").withColumn("p_partkey", F.col("p_partkey") + 10_000_000))


_NEW = """
SELECT p_partkey, p_name, p_size, CASE WHEN p_partkey % 50 = 0 THEN p_retailprice + 5 WHEN p_partkey % 50 = 1 THEN p_retailprice + 0.4 ELSE p_retailprice END AS p_retailprice
FROM part WHERE p_partkey % 20 <> 3 UNION ALL SELECT p_partkey + 10000000, p_name, p_size, p_retailprice FROM part WHERE p_partkey < 10
"""
_KEYED = """
SELECT class, COUNT(*) AS n FROM (
  SELECT CASE WHEN n.p_partkey IS NULL THEN 'left_only' WHEN o.p_partkey IS NULL THEN 'right_only' WHEN @changed THEN 'unequal' ELSE 'equal' END AS class
  FROM part o FULL JOIN (""" + _NEW + """) n ON o.p_partkey = n.p_partkey) t GROUP BY class
"""


@QUERIES.frame("q_keyed_diff", _KEYED.replace("@changed", "o.p_retailprice IS DISTINCT FROM n.p_retailprice"))
def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.diff_counts(compare.keyed_diff(*_versions(spark, sf_dir), compare.RowDiff(["p_partkey"])))


@QUERIES.frame("q_keyed_diff_tolerance", _KEYED.replace("@changed", "abs(o.p_retailprice - n.p_retailprice) > 1"))
def keyed_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = compare.RowDiff(["p_partkey"], exclude=["p_name"], tolerances={"p_retailprice": compare.Tolerance(absolute=1.0)})
    return compare.diff_counts(compare.keyed_diff(*_versions(spark, sf_dir), options))


@QUERIES.frame("q_diff_samples", "SELECT p_partkey FROM (SELECT p_partkey FROM part WHERE p_partkey % 20 = 3) t ORDER BY md5(concat_ws('|', '7', CAST(length(CAST(p_partkey AS VARCHAR)) AS VARCHAR), CAST(p_partkey AS VARCHAR))), p_partkey LIMIT 3")
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = compare.keyed_diff(*_versions(spark, sf_dir), compare.RowDiff(["p_partkey"]))
    return compare.diff_samples(diff, ["p_partkey"], "left_only", seed=7).select("p_partkey")


@QUERIES.frame(
    "q_multiset_diff",
    """
    SELECT p_brand, CAST(greatest(l - r, 0) AS BIGINT) AS left_surplus, CAST(greatest(r - l, 0) AS BIGINT) AS right_surplus FROM (
      SELECT p_brand, COUNT(*) FILTER (WHERE p_size > 10) AS l, COUNT(*) FILTER (WHERE p_size < 40) AS r FROM part GROUP BY p_brand) t WHERE l <> r
    """,
)
def multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = tables_of(spark, sf_dir, "part")
    return compare.multiset_diff(part.where("p_size > 10").select("p_brand"), part.where("p_size < 40").select("p_brand"))


@QUERIES.frame("q_unit_test_counts", "SELECT false AS passed, 5 AS actual_rows, 5 AS expected_rows, 1 AS missing, 1 AS unexpected")
def unit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions against expected rows of which one is wrong."""
    (region,) = tables_of(spark, sf_dir, "region")
    expected = region.withColumn("r_name", F.when(F.col("r_regionkey") == 2, "ASIA MINOR").otherwise(F.col("r_name")))
    v = compare.compare_expected(region, expected)
    return spark.createDataFrame([(v.passed, v.actual_rows, v.expected_rows, v.missing, v.unexpected)], "passed boolean, actual_rows int, expected_rows int, missing int, unexpected int")


@QUERIES.frame("q_schema_diff", "SELECT * FROM (VALUES ('note', 'missing', 'VARCHAR', ''), ('s_acctbal', 'extra', '', 'double'), ('s_nationkey', 'type', 'BIGINT', 'int')) t(name, kind, expected, found)")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    (supplier,) = tables_of(spark, sf_dir, "supplier")
    found = schema.compare_schemas({"S_SUPPKEY": "BIGINT", "s_name": "TEXT", "s_nationkey": "BIGINT", "note": "VARCHAR"}, supplier)
    return spark.createDataFrame([(f.column, f.kind, f.expected, f.found) for f in found], "name string, kind string, expected string, found string")


@QUERIES.frame("q_freshness", "SELECT epoch_us(MAX(ts)) AS version_us, MAX(ts) < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 12 HOURS AS stale FROM events")
def observed_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables_of(spark, sf_dir, "events")
    seen = datetime.fromisoformat(freshness.observe_column("events", events, "ts").version)
    stale = freshness.too_old(seen, datetime(2024, 2, 1), timedelta(hours=12))
    return spark.createDataFrame([(seen, stale)], "version timestamp_ntz, stale boolean").select(F.unix_micros(F.col("version").cast("timestamp")).alias("version_us"), "stale")
