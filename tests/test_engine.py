"""The engine over sources that change, and over targets that must not be written whole."""

from __future__ import annotations

import os
from dataclasses import replace
from datetime import date, datetime
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from millrace.operators.quality import Audit
from millrace.operators.warehouse import Warehouse
from millrace.plans.engine import Engine
from millrace.plans.intervals import Interval
from millrace.plans.project import Function, Model, Project, Seed, Source


def days(spark, path, low, high, value=1):
    rows = spark.range(low, high).select(F.col("id").alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.lit(value).alias("v"))
    rows.coalesce(1).write.mode("append").parquet(path)


def done(results):
    assert all(r.status == "done" for r in results), results
    return [r.action for r in results]


def test_rows_that_come_reach_views_tables_and_increments(spark, tmp_path):
    path = str(tmp_path / "src")
    days(spark, path, 0, 5)
    shop = Project().add(
        Source("s", path=path),
        Model("v", 'SELECT * FROM __source("s")'),
        Model("t", 'SELECT count(*) AS n FROM __ref("v")', "table"),
        Model("i", 'SELECT k, day FROM __source("s") WHERE day >= __cursor_start() AND day < __cursor_end()', "incremental", strategy="delete_insert", cursor="day", cursor_grain="day", replay_on_change="bounded-3d"),
    )
    engine = Engine(spark, shop, Warehouse(spark, "engine_sources"))
    count = lambda: (engine.warehouse.read("v").count(), engine.warehouse.read("t").first()[0], engine.warehouse.read("i").count())
    assert done(engine.build()) == ["create"] * 3 and count() == (5, 5, 5) and engine.warehouse.kind("v") == "view"
    assert dict(zip("ivt", (e.action for e in sorted(engine.plan(), key=lambda e: "ivt".index(e.model))), strict=True)) == {"i": "increment", "v": "skip", "t": "skip"}
    days(spark, path, 5, 9)
    assert sorted(done(engine.build())) == ["increment", "replace", "skip"] and count() == (9, 9, 9)
    assert [e.action for e in engine.plan(["t"])] == ["skip"]
    # A change of the statement is replayed three days back from the end, and no further.
    shop.models["i"] = replace(shop.models["i"], sql=shop.models["i"].sql.replace("SELECT k,", "SELECT k + 100 AS k,"))
    assert "replay" in done(engine.build())
    assert sorted(r.k for r in engine.warehouse.read("i").collect()) == [0, 1, 2, 3, 4, 5, 106, 107, 108]


def test_tolerated_and_unknown_versions(spark):
    spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 10:00:00' AS at").createOrReplaceTempView("clock_view")
    shop = Project().add(Source("c", sql="SELECT 1 AS one", freshness_sql="SELECT at FROM clock_view", tolerated="2h"), Model("m", 'SELECT * FROM __source("c")', "table"))
    engine = Engine(spark, shop, Warehouse(spark, "engine_tolerated"))
    done(engine.build())
    for at, action in (("11:00", "skip"), ("13:00", "replace"), ("13:00", "skip")):
        spark.sql(f"SELECT TIMESTAMP_NTZ '2024-01-01 {at}:00' AS at").createOrReplaceTempView("clock_view")
        assert done(engine.build()) == [action], at
    spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ) AS at").createOrReplaceTempView("clock_view")
    assert done(engine.build()) == ["replace"] and done(engine.build()) == ["replace"]


def files_of(engine, name):
    where = urlparse(engine.spark.sql(f"DESCRIBE TABLE EXTENDED {engine.warehouse.name(name)}").where("col_name = 'Location'").first().data_type).path
    return {str(p.relative_to(where)): os.stat(p).st_mtime_ns for p in Path(where).rglob("*.parquet")}


@pytest.mark.parametrize("strategy", ["delete_insert", "merge"])
def test_only_touched_partitions_are_written(spark, tmp_path, strategy):
    path = str(tmp_path / "src")
    days(spark, path, 0, 6)
    model = Model("p", 'SELECT k, v, day FROM __source("s") WHERE day >= __cursor_start() AND day < __cursor_end()', "incremental", strategy=strategy, unique_key=("k",), cursor="day", cursor_grain="day", partition_by="day", audits=(Audit("known", "not_null", "k"),))
    engine = Engine(spark, Project().add(Source("s", path=path), model), Warehouse(spark, f"engine_parts_{strategy}"))
    done(engine.build())
    before = files_of(engine, "p")
    days(spark, path, 6, 8, value=2)
    done(engine.build())
    after = files_of(engine, "p")
    untouched = {f for f in before if not f.startswith("day=2024-01-06")}
    assert len(untouched) == 5 and all(after[f] == before[f] for f in untouched)
    assert sorted((r.k, r.v) for r in engine.warehouse.read("p").collect()) == [(i, 1 if i < 6 else 2) for i in range(8)]


def test_a_partition_that_ends_empty_is_dropped(spark):
    rows = "SELECT * FROM VALUES (1, DATE '2024-01-01'), (2, DATE '2024-01-02') AS t(k, day)"
    sql = 'SELECT * FROM __source("s") WHERE day >= __cursor_start() AND day < __cursor_end()'
    shop = Project().add(Source("s", sql=rows), Model("p", sql, "incremental", strategy="delete_insert", cursor="day", cursor_grain="day", partition_by="day"))
    engine = Engine(spark, shop, Warehouse(spark, "engine_empty"))
    done(engine.build())
    shop.sources["s"] = Source("s", sql=rows + " WHERE k = 2")
    done(engine.build(window=Interval(date(2024, 1, 1), date(2024, 1, 3))))
    assert [r.k for r in engine.warehouse.read("p").collect()] == [2]


def test_appends_add_files_and_blocked_appends_do_not(spark, tmp_path):
    path = str(tmp_path / "src")
    days(spark, path, 0, 3)
    model = Model("a", 'SELECT k, day FROM __source("s") WHERE day >= __cursor_start() AND day < __cursor_end()', "incremental", strategy="append", cursor="k", audits=(Audit("few", "unique", "k"),))
    model = replace(model, sql='SELECT k, day FROM __source("s") WHERE k >= __cursor_start() AND k < __cursor_end()')
    engine = Engine(spark, Project().add(Source("s", path=path), model), Warehouse(spark, "engine_append"))
    done(engine.build(window=Interval(0, 3)))
    before = files_of(engine, "a")
    days(spark, path, 3, 5)
    done(engine.build(window=Interval(3, 5)))
    after = files_of(engine, "a")
    assert before.items() <= after.items() and len(after) > len(before) and engine.warehouse.read("a").count() == 5
    assert engine.build(window=Interval(4, 5))[0].status == "failed" and engine.warehouse.read("a").count() == 5


def test_a_first_run_in_batches_shows_up_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "src")
    days(spark, path, 0, 6)
    seen = []
    model = Model("b", 'SELECT k, day, v, 1 / (k - 4) AS bad FROM __source("s") WHERE day >= __cursor_start() AND day < __cursor_end()', "incremental", strategy="delete_insert", cursor="day", cursor_grain="day", batch_size=2, batch_concurrency=2)
    shop = Project().add(Source("s", path=path), model)
    engine = Engine(spark, shop, Warehouse(spark, "engine_first"))
    assert engine.build()[0].status == "failed" and not engine.warehouse.exists("b") and not [r for r in engine.warehouse.relations() if "b" in r.split("__") or r.endswith("__b")]
    shop.models["b"] = replace(model, sql=model.sql.replace("1 / (k - 4)", "k"), audits=(Audit("all", "unique", "k"),))
    result = engine.build()[0]
    assert (result.status, result.batches) == ("done", 3) and engine.warehouse.read("b").count() == 6
    assert [(c.interval.start, c.known_missing) for c in engine.completions(shop.models["b"])] == [(date(2024, 1, 1), False), (date(2024, 1, 3), False), (date(2024, 1, 5), False)] and not seen


def test_gaps_are_run_as_the_policy_says(spark, tmp_path):
    path = str(tmp_path / "src")
    days(spark, path, 0, 2)
    days(spark, path, 4, 6)
    model = Model("g", 'SELECT k, day FROM __source("s") WHERE day >= __cursor_start() AND day < __cursor_end()', "incremental", strategy="delete_insert", cursor="day", cursor_grain="day", batch_size=2, unaccounted_partition_policy="recover_empty")
    shop = Project().add(Source("s", path=path), model)
    engine = Engine(spark, shop, Warehouse(spark, "engine_gaps"))
    done(engine.build())
    assert engine.gaps(model) == [Interval(date(2024, 1, 3), date(2024, 1, 5))]
    days(spark, path, 2, 4)
    done(engine.build())
    assert engine.warehouse.read("g").count() == 6 and engine.gaps(model) == []
    assert engine.gaps(replace(model, unaccounted_partition_policy="synthesize")) == []


def test_cursor_inputs_and_horizon(spark):
    shop = Project().add(
        Source("a", sql="SELECT TIMESTAMP_NTZ '2024-01-01 10:00:00' AS at UNION ALL SELECT TIMESTAMP_NTZ '2999-01-01 00:00:00'"),
        Source("b", sql="SELECT TIMESTAMP_NTZ '2024-01-01 09:00:00' AS at"),
        Model("m", 'SELECT a.at FROM __source("a") a LEFT JOIN __source("b") b ON a.at = b.at WHERE a.at >= __cursor_start() AND a.at < __cursor_end()', "incremental", strategy="append", cursor="at", cursor_grain="hour", cursor_inputs=("a",), cursor_future_distance="1d"),
    )
    engine = Engine(spark, shop, Warehouse(spark, "engine_horizon"))
    done(engine.build())
    assert [r.at for r in engine.warehouse.read("m").collect()] == [datetime(2024, 1, 1, 10)]


def test_historical_snapshots_and_their_columns(spark):
    rows = lambda *v: "SELECT * FROM VALUES " + ", ".join(f"(1, '{p}', {o})" for p, o in v) + " AS t(k, plan, seen)"
    shop = Project().add(
        Source("s", sql=rows(("free", 1), ("free", 2), ("pro", 3))),
        Model("h", 'SELECT * FROM __source("s")', "snapshot", unique_key=("k",), snapshot_strategy="check", check_columns=("plan",), observed_at="seen", historical_input=True, valid_from_column="since", valid_to_column="until"),
    )
    engine = Engine(spark, shop, Warehouse(spark, "engine_history"))
    done(engine.build())
    shop.sources["s"] = Source("s", sql=rows(("pro", 4), ("free", 5)))
    done(engine.build())
    assert sorted((r.plan, r.since, r.until) for r in engine.warehouse.read("h").collect()) == [("free", 1, 3), ("free", 5, None), ("pro", 3, 5)]
    assert done(engine.build(full_refresh=True)) == ["snapshot"]
    shop.models["h"] = replace(shop.models["h"], snapshot_full_refresh=True)
    assert done(engine.build(full_refresh=True)) == ["replace"] and engine.warehouse.read("h").count() == 2


def test_seeds_python_functions_and_migration(spark, tmp_path):
    seed = tmp_path / "codes.csv"
    seed.write_text("id,name\n1,one\n2,\n")
    shop = Project().add(
        Seed("codes", str(seed), {"id": "BIGINT", "name": "VARCHAR"}),
        Function("shout", "", "string", python=lambda s: s.str.upper() + "!"),
        Model("view_of_seed", 'SELECT * FROM __seed("codes")'),
        Model("loud", 'SELECT id, __udf("shout")(name) AS name FROM __seed("codes")', "table"),
    )
    engine = Engine(spark, shop, Warehouse(spark, "engine_seed"))
    done(engine.build())
    assert sorted((r.id, r.name) for r in engine.warehouse.read("loud").collect()) == [(1, "ONE!"), (2, None)]
    seed.write_text("id,name\n1,one\n2,two\n3,three\n")
    assert sorted(done(engine.build())) == ["replace", "skip"]
    assert engine.warehouse.read("view_of_seed").count() == engine.warehouse.read("loud").count() == 3
    shop.models["loud2"] = replace(shop.models.pop("loud"), name="loud2", migrate_from="loud")
    done(engine.build())
    assert engine.warehouse.exists("loud2") and not engine.warehouse.exists("loud")
    shop.models["bad"] = Model("bad", 'SELECT __udf("shout")(name) AS name FROM __seed("codes")')
    assert [r.status for r in engine.build(["bad"])] == ["failed"]
