"""Edges of the operators: nulls, duplicates, ties, empty frames, failures."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import compat
from millrace.functions.text import jaro_winkler
from millrace.operators import compare, joins, quality, schema, snapshot, write
from millrace.operators.warehouse import AuditFailure, Warehouse, artifact_name
from millrace.sources import freshness, loaders, seeds


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_merge_rejects_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(write.WriteError):
        write.merge(target, spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string"), ["k"])


def test_merge_adds_null_keys_and_aligns_columns(spark):
    target = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    merged = write.merge(target, spark.createDataFrame([("b", 1), ("x", None)], "V string, K int"), ["k"])
    assert rows(merged) == [(1, "b"), (None, "n"), (None, "x")]


def test_range_delete_keeps_rows_without_cursor(spark):
    target = spark.createDataFrame([(1, "a"), (5, "b"), (None, "c")], "c int, v string")
    left = write.delete_insert_by_range(target, spark.createDataFrame([(4, "new")], "c int, v string"), "c", 1, 5)
    assert rows(left) == [(4, "new"), (5, "b"), (None, "c")]


def test_extra_columns_are_an_error(spark):
    with pytest.raises(write.WriteError):
        write.append(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1, 2)], "a int, b int"))


def test_partition_overwrite_leaves_others(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string").write.partitionBy("p").parquet(path)
    write.overwrite_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, "p")
    assert rows(spark.read.parquet(path).select("v", "p")) == [(1, "a"), (9, "b")]


@pytest.mark.parametrize("cut", [False, True])
def test_asof_ties_nulls_and_missing(spark, cut):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 25), (3, "b", 5), (4, None, 9), (5, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 7, 3), ("a", None, 9), (None, 1, 8)], "k string, t int, v int")
    found = joins.asof_join(left, right, ["k"], "t", "t", ["v"], F.floor(F.col("_time") / 10) if cut else None)
    assert {r.id: r.v for r in found.collect()} == {1: 2, 2: 3, 3: None, 4: None, 5: None}


def test_hierarchy_leaves_cycles_out(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "id int, parent int")
    assert rows(joins.hierarchy(edges, "id", "parent")) == [(1, 1, 1, "/1"), (2, 2, 1, "/1/2"), (3, 3, 1, "/1/2/3")]


def test_snapshot_reappearing_key(spark):
    history = snapshot.initial(spark.createDataFrame([("a", 1), ("b", 1)], "k string, u int"), F.col("u"))
    gone = snapshot.current_timestamp(history, spark.createDataFrame([("a", 1)], "k string, u int"), ["k"], "u", True, F.lit(5))
    assert rows(gone) == [("a", 1, 1, None), ("b", 1, 1, 5)]
    back = snapshot.current_timestamp(gone, spark.createDataFrame([("a", 1), ("b", 7)], "k string, u int"), ["k"], "u", True, F.lit(9))
    assert rows(back) == [("a", 1, 1, None), ("b", 1, 1, 5), ("b", 7, 7, None)]


def test_snapshot_checks_are_null_safe(spark):
    observed = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("a", "x", 3), ("a", None, 4), (None, "q", 1)], "k string, c string, t int")
    found = snapshot.historical_check(observed, ["k"], ["c"], "t")
    assert rows(found.select("k", "c", "valid_from", "valid_to")) == [("a", "x", 3, 4), ("a", None, 1, 3), ("a", None, 4, None), (None, "q", 1, None)]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("NUMBER(38,0)", "DECIMAL(38)", True), ("VARCHAR", "text", True), ("VARCHAR(5)", "VARCHAR(6)", False), ("timestamp_ntz", "TIMESTAMP", True), ("INT", "BIGINT", False), ("ARRAY<INT>", "array < int >", True), ("double precision", "FLOAT64", True)],
)
def test_type_shapes(a, b, same):
    assert (schema.normalise_type(a) == schema.normalise_type(b)) is same


def test_schema_policies():
    target, delta = {"a": "int", "b": "string"}, {"a": "bigint", "c": "date"}
    assert schema.schema_actions(target, delta) == [("add", "c", "date")]
    assert schema.schema_actions(target, delta, "sync_all_columns") == [("add", "c", "date"), ("drop", "b", "string"), ("retype", "a", "bigint")]
    assert schema.schema_actions(target, delta, "ignore") == []
    with pytest.raises(ValueError):
        schema.schema_actions(target, delta, "fail")


def test_enforcement_fails_on_values_that_do_not_fit(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        schema.enforce_types(spark.createDataFrame([("x",)], "a string"), {"a": "INT"}).collect()


def test_dynamic_columns():
    found = {"id": "bigint", "m_1": "double", "m_2": "string", "z": "int"}
    kinds = [(f.column, f.kind) for f in schema.compare_schemas({"id": "BIGINT"}, found, r"m_\d+", "DOUBLE")]
    assert kinds == [("m_2", "type"), ("z", "extra")]


@pytest.mark.parametrize(("value", "samples", "status"), [(100, 5, "pass"), (95, 5, "warn"), (80, 5, "error"), (80, 2, "insufficient"), (None, 9, "insufficient"), (99, None, "insufficient")])
def test_measurements(spark, value, samples, status):
    limits = quality.Thresholds(warn_below=99, error_below=90, least_samples=3)
    assert quality.judge(value, samples, limits) == status
    frame = spark.createDataFrame([(None if value is None else float(value), samples)], "value double, sample_count int")
    assert frame.select(quality.judged(F.col("value"), F.col("sample_count"), limits)).first()[0] == status
    assert quality.measure(frame, limits)[0] == status


def test_audit_identity_ignores_argument_order():
    a = quality.Audit("x", "accepted_values", "c", {"values": [1], "note": "n"})
    b = quality.Audit("x", "accepted_values", "c", {"note": "n", "values": [1]})
    assert a.fingerprint() == b.fingerprint() != quality.Audit("x", "not_null", "c").fingerprint()


def test_diff_tolerance_and_nulls(spark):
    left = spark.createDataFrame([(1, 10.0), (2, None), (3, 5.0), (4, None), (None, 1.0)], "k int, v double")
    right = spark.createDataFrame([(1, 10.9), (2, None), (3, None), (5, 1.0), (None, 1.0)], "k int, v double")
    diff = compare.keyed_diff(left, right, compare.RowDiff(["k"], tolerances={"v": compare.Tolerance(absolute=1)}))
    assert {r.k: r["class"] for r in diff.collect()} == {1: "equal", 2: "equal", 3: "unequal", 4: "left_only", 5: "right_only", None: "equal"}


def test_unit_test_samples(spark):
    v = compare.compare_expected(spark.createDataFrame([(1, "a"), (1, "a")], "k int, v string"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"))
    assert (v.passed, v.missing, v.unexpected, v.samples) == (False, 1, 1, (("v", "b", "a"),))
    with pytest.raises(ValueError):
        compare.compare_expected(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2)], "k int, z int"))


def test_failed_audit_keeps_the_live_table(spark):
    house = Warehouse(spark, "audit_test")
    house.replace_staged("t", spark.range(3))

    def check(_):
        raise AuditFailure("no")

    with pytest.raises(AuditFailure):
        house.replace_staged("t", spark.range(9), check)
    assert house.read("t").count() == 3
    house.replace_staged("t", house.read("t").where("id > 0"))
    assert house.read("t").count() == 2
    assert house.relations() == ["t"]
    assert house.clone("t", Warehouse(spark, "clone_test")) == "cloned"
    assert house.clone("none", Warehouse(spark, "clone_test")) == "missing"
    assert house.clean({"x"}) == ["t"]


def test_artifact_names():
    assert artifact_name("p_", "x") == "p_x"
    long = artifact_name("p_", "x" * 200)
    assert len(long) == 128 and long != artifact_name("p_", "x" * 201)


def test_loader_types(spark):
    staged = loaders.stage(spark, [{"a": 1, "b": None}, {"a": 2.5, "b": {"z": 1, "a": [1]}}])
    assert dict(staged.dtypes) == {"a": "double", "b": "string"}
    assert rows(staged) == [(1.0, None), (2.5, '{"a":[1],"z":1}')]
    with pytest.raises(ValueError):
        loaders.stage(spark, [{"a": 1}, {"a": "x"}])
    with pytest.raises(ValueError):
        loaders.load(staged, loaders.stage(spark, [{"a": 1.0, "c": 1}]), "append", contract=True)
    assert loaders.stage(spark, []).count() == 0


@pytest.mark.parametrize(
    ("settings", "expected"),
    [
        (seeds.SeedSettings(), [None, "N/A", "unknown", "506799"]),
        (seeds.SeedSettings(keep_default_na=False), ["", "N/A", "unknown", "506799"]),
        (seeds.SeedSettings(na_values=("N/A", "unknown")), [None, None, None, "506799"]),
        (seeds.SeedSettings(na_values=("N/A",), keep_default_na=False), ["", None, "unknown", "506799"]),
        (seeds.SeedSettings(na_values={"other": ("N/A",)}), [None, "N/A", "unknown", "506799"]),
    ],
)
def test_seed_missing_values(spark, tmp_path, settings, expected):
    path = tmp_path / "seed.csv"
    path.write_text('id,v\n1,""\n2,N/A\n3,unknown\n4,506799\n')
    found = seeds.read_seed(spark, str(path), {"id": "INTEGER", "v": "VARCHAR"}, settings)
    assert [r.v for r in found.orderBy("id").collect()] == expected


def test_freshness():
    old, new = (freshness.Freshness("s", "column:t", v) for v in ("2024-01-01T00:00:00", "2024-01-01T01:00:00"))
    assert freshness.compare(None, old) == "new"
    assert freshness.compare(old, old) == "unchanged"
    assert freshness.compare(old, new) == "changed"
    assert freshness.compare(old, new, timedelta(hours=2)) == "tolerated"
    assert freshness.compare(old, freshness.Freshness("s", "column:t", None)) == "unknown"


@pytest.mark.parametrize(("a", "b", "score"), [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("", "", 1.0), ("a", "", 0.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, score):
    assert jaro_winkler(a, b) == pytest.approx(score, abs=1e-6)


def test_calendar_overflow(spark):
    made = spark.range(1).select(compat.date_from_parts(F.lit(2024), F.lit(13), F.lit(0)).cast("string").alias("a"), compat.add_months_keep_end(F.lit("2024-02-29").cast("date"), F.lit(1)).cast("string").alias("b"))
    assert tuple(made.first()) == ("2024-12-31", "2024-03-31")
