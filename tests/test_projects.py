"""Projects: graphs, selection, rendering, planning, and builds that fail half way."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators.quality import Audit
from millrace.operators.warehouse import Warehouse
from millrace.plans.engine import Engine
from millrace.plans.intervals import Interval
from millrace.plans.planner import change_kind, plan_model, state_of
from millrace.plans.project import Model, Project, ProjectError, Source


def project() -> Project:
    return Project().add(
        Source("raw", sql="SELECT * FROM VALUES (1, 'a', TIMESTAMP_NTZ '2024-01-01 10:00:00'), (2, 'b', TIMESTAMP_NTZ '2024-01-02 11:00:00') AS t(id, name, at)"),
        Model("base", 'SELECT * FROM __source("raw")', "table", audits=(Audit("known", "not_null", "id"),)),
        Model("leaf", 'SELECT id FROM __ref("base")', "table"),
    )


def test_bad_projects():
    with pytest.raises(ProjectError, match="circle"):
        Project().add(Model("a", 'SELECT * FROM __ref("b")'), Model("b", 'SELECT * FROM __ref("a")')).order()
    with pytest.raises(ProjectError, match="unknown"):
        Project().add(Model("a", 'SELECT * FROM __ref("nothing")')).order()
    with pytest.raises(ProjectError, match="twice"):
        Project().add(Model("a", "SELECT 1"), Model("a", "SELECT 2"))


def test_rendering():
    shop = Project(constants={"low": 3, "kind": "x"}, macros={"twice": lambda c: f"({c} * 2)"})
    model = Model("m", "SELECT @sql.twice(v) FROM __ref('a') WHERE v > @const.low AND k = @const.kind AND t >= __cursor_start() AND z = @@@zone")
    text = shop.render(model, lambda kind, name: f"<{kind}:{name}>", ("1", "2"), {"zone": "'UTC'"})
    assert text == "SELECT (v * 2) FROM <ref:a> WHERE v > 3 AND k = 'x' AND t >= 1 AND z = 'UTC'"
    with pytest.raises(ProjectError, match="bounds"):
        shop.render(model, lambda kind, name: name, None, {"zone": "1"})


def test_query_hash_ignores_layout_but_not_literals():
    one = Model("m", "SELECT a, 'X  y' -- note\n FROM t;")
    assert one.query_hash() == Model("m", "select A,   'X  y' from T").query_hash()
    assert one.query_hash() != Model("m", "select a, 'x  y' from t").query_hash()


def test_change_precedence():
    shop = project()
    model = shop.models["leaf"]
    before = state_of(shop, model)
    shop.models["leaf"] = replace(model, sql="SELECT 1 AS id", lookback="1d", columns={"id": "INT"})
    now = state_of(shop, shop.models["leaf"])
    assert change_kind(None, now) == "new"
    assert change_kind(before, now) == "query"
    assert change_kind(before, replace(now, query=before.query)) == "schema"
    assert change_kind(before, replace(now, query=before.query, schema=before.schema)) == "config"
    assert change_kind(before, before) == "none"


def test_replay_of_changed_increments():
    shop = Project().add(Model("m", "SELECT 1 AS a", "incremental", cursor="t"))
    before = replace(state_of(shop, shop.models["m"]), query="other")
    window = Interval(datetime(2024, 1, 10), datetime(2024, 1, 12))
    entry = lambda policy: plan_model(Project().add(replace(shop.models["m"], replay_on_change=policy)), "m", before, True, window=window)
    assert (entry("forward").action, entry("full").action, entry("bounded-7d").action) == ("increment", "replace", "replay")
    assert entry("bounded-7d").window.start == datetime(2024, 1, 5)


def test_build_again_and_after_an_edit(spark):
    shop = project()
    engine = Engine(spark, shop, Warehouse(spark, "build_again"))
    assert [(r.model, r.action, r.status) for r in engine.build(workers=2)] == [("base", "create", "done"), ("leaf", "create", "done")]
    assert [r.action for r in engine.build()] == ["skip", "skip"]
    shop.models["base"] = replace(shop.models["base"], sql=shop.models["base"].sql + " WHERE id > 1")
    assert [r.action for r in engine.build()] == ["replace", "replace"]
    assert engine.warehouse.read("leaf").count() == 1


def test_failed_audit_stops_what_is_behind(spark):
    shop = project()
    shop.models["base"] = replace(shop.models["base"], audits=(Audit("few", "accepted_values", "name", {"values": ["a"]}),))
    results = Engine(spark, shop, Warehouse(spark, "build_failed")).build()
    assert [(r.status, bool(r.error)) for r in results] == [("failed", True), ("skipped", True)]
    shop.models["base"] = replace(shop.models["base"], audits=(Audit("few", "accepted_values", "name", {"values": ["a"]}, severity="warn"),))
    results = Engine(spark, shop, Warehouse(spark, "build_failed")).build()
    assert [r.status for r in results] == ["done", "done"] and results[0].audits[0].status == "warn"


def test_contract_and_hooks(spark):
    ran = []
    shop = project()
    shop.models["base"] = replace(shop.models["base"], columns={"id": "INT", "name": "VARCHAR"}, contract=True, pre_hooks=(lambda e: ran.append("pre"),), post_hooks=(lambda e: ran.append("post"),))
    engine = Engine(spark, shop, Warehouse(spark, "build_contract"))
    assert engine.build(["base"])[0].status == "failed" and ran == ["pre"]
    shop.models["base"] = replace(shop.models["base"], columns={"id": "BIGINT", "name": "VARCHAR", "at": "TIMESTAMP"})
    assert engine.build(["base"])[0].status == "done" and ran == ["pre", "pre", "post"]
    assert dict(engine.warehouse.read("base").dtypes)["id"] == "bigint"


def test_snapshot_model(spark):
    shop = Project().add(Source("s", sql="SELECT 1 AS k, 'free' AS plan, 1 AS u"), Model("h", 'SELECT * FROM __source("s")', "snapshot", unique_key=("k",), snapshot_strategy="timestamp", updated_at="u"))
    engine = Engine(spark, shop, Warehouse(spark, "build_snapshot"))
    engine.build()
    shop.sources["s"] = Source("s", sql="SELECT 1 AS k, 'pro' AS plan, 5 AS u")
    assert engine.build()[0].action == "snapshot"
    found = sorted((r.plan, r.valid_from, r.valid_to) for r in engine.warehouse.read("h").collect())
    assert found == [("free", 1, 5), ("pro", 5, None)]


def test_loader_source_and_merge_model(spark):
    batches = [[{"k": 1, "v": "a"}, {"k": 2, "v": "b"}], [{"k": 2, "v": "c"}]]
    shop = Project().add(
        Source("l", loader=lambda: batches[0], strategy="merge", unique_key=("k",)),
        Model("m", 'SELECT * FROM __source("l")', "incremental", strategy="merge", unique_key=("k",)),
    )
    engine = Engine(spark, shop, Warehouse(spark, "build_merge"))
    engine.build()
    batches.pop(0)
    assert engine.build()[0].status == "done"
    assert sorted(tuple(r) for r in engine.warehouse.read("m").collect()) == [(1, "a"), (2, "c")]


def test_custom_materialization_and_migration(spark):
    shop = Project().add(Model("c", "SELECT 7 AS v", "custom", materialize=lambda engine, model: engine.warehouse.replace_staged(model.name, spark.sql(model.sql).withColumn("w", F.lit(1)))))
    engine = Engine(spark, shop, Warehouse(spark, "build_custom"))
    engine.build()
    assert engine.warehouse.read("c").columns == ["v", "w"]
    moved = Model("d", "SELECT 7 AS v", "table", migrate_from="c", old_name_view=True)
    assert engine.migrate(moved) and not engine.migrate(moved)
    assert engine.warehouse.kind("c") == "view" and engine.warehouse.read("c").count() == 1
