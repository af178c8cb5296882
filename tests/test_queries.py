"""Every query against its statement, at the smallest size."""

from __future__ import annotations

import os
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path

import duckdb
import pytest

from millrace import queries
from tests.oracle import connection, same_rows

FUNCTIONS, ORACLES = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


def test_every_query_has_a_statement():
    assert sorted(FUNCTIONS) == sorted(ORACLES)


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_query_matches_its_statement(spark, sf_dir, con, name):
    same_rows(FUNCTIONS[name](spark, sf_dir), con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(FUNCTIONS) <= set(__spark_entry__.queries())


def test_delete_insert_covers_the_whole_table(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    found = FUNCTIONS["q_loader_delete_insert_whole"](spark, sf_dir)
    assert found.count() == events > 100 and found.where("event_type = 'new'").count() == 50


def test_flatten_gives_every_element(spark, sf_dir):
    elements = sum(len(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding").collect())
    assert FUNCTIONS["q_lateral_flatten_whole"](spark, sf_dir).count() == elements


@pytest.mark.parametrize("name", ["q_stream_session", "q_stream_dedup"])
def test_streams_keep_files_out_of_time_order(spark, sf_dir, tmp_path, name):
    """Three files of five events, of days 120, 1 and 2."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for at, day in enumerate((120, 1, 2)):
        made = spark.range(at * 5, at * 5 + 5).selectExpr("id AS event_id", f"TIMESTAMP '2024-01-01' + make_dt_interval({day}, CAST(id AS INT)) AS ts", "1 AS user_id", "'view' AS event_type")
        rows = made.selectExpr(*(f"CAST({f.name if f.name in made.columns else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema))
        rows.coalesce(1).write.parquet(str(tmp_path / f"part{at}"))
        (written,) = Path(tmp_path / f"part{at}").glob("*.parquet")
        written.rename(folder / f"{at}.parquet")
        os.utime(folder / f"{at}.parquet", (1_700_000_000 + 60 * at,) * 2)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/*.parquet'")
    same_rows(FUNCTIONS[name](spark, str(tmp_path)), con, ORACLES[name])


def test_recursion_goes_beyond_the_row_limit_of_the_session(spark, sf_dir, con):
    key = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(key, "50")
    try:
        assert spark.read.parquet(f"{sf_dir}/part.parquet").count() > 50
        same_rows(FUNCTIONS["q_recursive_cte"](spark, sf_dir), con, ORACLES["q_recursive_cte"])
        assert spark.conf.get(key) == "50"
    finally:
        spark.conf.unset(key)


def _priced(spark, folder, lines) -> dict:
    spark.createDataFrame(lines, "l_orderkey bigint, l_extendedprice double, l_discount double").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return {r.order_key: r.net for r in FUNCTIONS["q_cte_chain"](spark, str(folder)).collect()}


def test_sums_that_end_in_a_half_do_not_depend_on_the_order_of_the_rows(spark, tmp_path):
    """Orders 78198 and 140331 of sf0.1, whose sums of doubles fall below the half in the order of the file, and refunds of them."""
    orders = (
        [(70064.82, 0.07), (68805.16, 0.02), (72171.5, 0.01), (99758.83, 0.05), (4133.12, 0.05), (89076.25, 0.05), (50422.76, 0.04), (15834.74, 0.04), (20568.11, 0.04)],
        [(91471.09, 0.02), (8578.88, 0.1), (97890.51, 0.06), (37164.27, 0.04), (7297.91, 0.0), (50167.9, 0.1), (54883.88, 0.01)],
    )
    orders += tuple([(-price, discount) for price, discount in o] for o in orders)
    dealt = [way for o in orders for way in (o, o[::-1], sorted(o))]
    true = [sum(Decimal(str(price)) * (1 - Decimal(str(discount))) for price, discount in way) for way in dealt]
    assert {t % 1 for t in true} == {Decimal("0.5"), Decimal("-0.5")}
    found = _priced(spark, tmp_path, [(key, *line) for key, way in enumerate(dealt) for line in way])
    assert found == {key: int(t.quantize(Decimal(1), ROUND_HALF_UP)) for key, t in enumerate(true)}


def test_sums_of_values_that_are_no_steps_of_a_price(spark, tmp_path):
    """Nulls, more than four decimals, values and sums too large for whole numbers."""
    lines = [(1, None, 0.1), (1, 5.0, None), (2, None, 0.1), (2, 7.25, 0.0), (3, 0.123456, 0.0), (3, 1 / 3, 0.0), (3, 0.5, 1 / 7), (4, 1e15, 0.5), (4, 2.0, 0.0), (5, 9.0, 12345.0), (6, 1e-9, 1e-9)]
    lines += [(7, 9.9e7, -9.0)] * 200 + [(8, -9.9e7, -9.0)] * 200
    found = _priced(spark, tmp_path, lines)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert found == {key: net for key, net, _ in con.execute(ORACLES["q_cte_chain"]).fetchall()}
    assert found[1] is None and found[7] == -found[8] == 198_000_000_000
