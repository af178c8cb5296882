"""A small project, planned, built, changed, tested, and traced."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.quality import Audit
from millrace.operators.warehouse import Warehouse
from millrace.plans.compiler import Compiler
from millrace.plans.engine import Engine
from millrace.plans.intervals import Completion, Interval, project_coverage
from millrace.plans.lineage import check_statement, column_lineage
from millrace.plans.planner import plan, state_of
from millrace.plans.project import Function, Model, Project, Source
from millrace.queries.base import QuerySet, tables_of
from millrace.storage import new_path, written

QUERIES = QuerySet()


def shop(sf_dir: str) -> Project:
    """Orders and their lines, joined and summed by day."""
    return Project(constants={"cancelled": "P"}, macros={"cents": lambda c: f"CAST(ROUND({c} * 100) AS BIGINT)"}).add(
        Source("orders", path=f"{sf_dir}/orders.parquet"),
        Source("lines", path=f"{sf_dir}/lineitem.parquet"),
        Function("is_kept", "status STRING, void STRING", "BOOLEAN", "status <> void"),
        Model("stg_orders", 'SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS order_day FROM __source("orders") WHERE __udf("is_kept")(o_orderstatus, @const.cancelled)', tags=("staging",), path="staging/orders"),
        Model("stg_lines", 'SELECT l_orderkey, l_quantity, @sql.cents(l_extendedprice) AS cents FROM __source("lines")', tags=("staging",), path="staging/lines"),
        Model(
            "fact_orders",
            'SELECT o.o_orderkey, o.o_custkey, o.order_day, SUM(CAST(l.l_quantity AS BIGINT)) AS quantity, SUM(l.cents) AS cents FROM __ref("stg_orders") o JOIN __ref("stg_lines") l ON l.l_orderkey = o.o_orderkey GROUP BY ALL',
            materialized="table",
            tags=("mart", "daily"),
            path="marts/orders",
            columns={"quantity": "BIGINT", "cents": "BIGINT"},
            audits=(Audit("order_key_known", "not_null", "o_orderkey"), Audit("order_key_unique", "unique", "o_orderkey")),
        ),
        Model(
            "daily_revenue",
            'SELECT order_day, COUNT(*) AS n_orders, SUM(quantity) AS quantity, SUM(cents) AS cents FROM __ref("fact_orders") WHERE order_day >= __cursor_start() AND order_day < __cursor_end() GROUP BY order_day',
            materialized="incremental",
            strategy="delete_insert",
            cursor="order_day",
            cursor_grain="day",
            lookback="3d",
            batch_size=1200,
            tags=("mart",),
            path="marts/revenue",
            replay_on_change="full",
        ),
    )


def _engine(spark: SparkSession, sf_dir: str, schema: str) -> Engine:
    spark.sql(f"DROP SCHEMA IF EXISTS {schema} CASCADE")
    return Engine(spark, shop(sf_dir), Warehouse(spark, schema))


@QUERIES.frame(
    "q_project_build",
    """
    SELECT CAST(day AS VARCHAR) AS order_day, COUNT(*) AS n_orders, CAST(SUM(quantity) AS BIGINT) AS quantity, CAST(SUM(cents) AS BIGINT) AS cents FROM (
      SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, SUM(CAST(l_quantity AS BIGINT)) AS quantity, SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS cents
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2) f GROUP BY day
    """,
)
def project_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built twice: the second run adds nothing but the days it looks back on."""
    engine = _engine(spark, sf_dir, "millrace_build")
    for _ in range(2):
        if failed := [r for r in engine.build() if r.status != "done"]:
            raise RuntimeError(str(failed))
    return engine.warehouse.read("daily_revenue").withColumn("order_day", F.col("order_day").cast("string"))


def _feed(spark: SparkSession, events: DataFrame, path: str, condition: str) -> None:
    events.where(condition).withColumn("day", F.to_date("ts")).select("event_id", "event_type", "day").write.mode("append").parquet(path)


def _fresh(spark: SparkSession, schema: str, project: Project) -> Engine:
    spark.sql(f"DROP SCHEMA IF EXISTS {schema} CASCADE")
    return Engine(spark, project, Warehouse(spark, schema))


def _built(engine: Engine, **options) -> list[str]:
    results = engine.build(**options)
    if failed := [r for r in results if r.status != "done"]:
        raise RuntimeError(str(failed))
    return [r.action for r in results]


@QUERIES.frame(
    "q_engine_rebuild",
    """
    SELECT 'clicks' AS model, CAST(CAST(ts AS DATE) AS VARCHAR) AS item, COUNT(*) AS n FROM events WHERE event_type = 'click' GROUP BY 2
    UNION ALL SELECT 'per_type', event_type || '!', COUNT(*) FROM events GROUP BY 2
    UNION ALL SELECT 'daily', CAST(CAST(ts AS DATE) AS VARCHAR), COUNT(*) FROM events GROUP BY 2
    """,
)
def engine_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built over half of the events; then the others come, and a model is edited: a view, a table over it and an
    incremental model all tell of every event."""
    (events,) = tables_of(spark, sf_dir, "events")
    path = new_path(spark, "feed")
    _feed(spark, events, path, "event_id % 2 = 0")
    project = Project().add(
        Source("feed", path=path),
        Model("all_events", 'SELECT * FROM __source("feed")'),
        Model("clicks", "SELECT * FROM __ref(\"all_events\") WHERE event_type = 'click'"),
        Model("per_type", 'SELECT event_type AS item, COUNT(*) AS n FROM __ref("all_events") GROUP BY 1', materialized="table"),
        Model(
            "daily",
            'SELECT day, COUNT(*) AS n FROM __ref("all_events") WHERE day >= __cursor_start() AND day < __cursor_end() GROUP BY day',
            materialized="incremental",
            strategy="delete_insert",
            cursor="day",
            cursor_grain="day",
            partition_by="day",
            lookback="400d",
        ),
    )
    engine = _fresh(spark, "millrace_rebuild", project)
    _built(engine)
    _feed(spark, events, path, "event_id % 2 <> 0")
    _built(engine)
    project.models["per_type"] = replace(project.models["per_type"], sql="SELECT event_type || '!' AS item, COUNT(*) AS n FROM __ref(\"all_events\") GROUP BY 1")
    _built(engine)
    read = engine.warehouse.read
    clicks = read("clicks").groupBy(F.col("day").cast("string").alias("item")).agg(F.count("*").alias("n"))
    daily = read("daily").select(F.col("day").cast("string").alias("item"), "n")
    named = lambda name, rows: rows.select(F.lit(name).alias("model"), "item", "n")
    return named("clicks", clicks).unionByName(named("per_type", read("per_type"))).unionByName(named("daily", daily))


@QUERIES.frame("q_engine_gaps", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(*) AS n FROM events GROUP BY 1")
def engine_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second week's events come last: its batch was empty, and the policy runs it again."""
    (events,) = tables_of(spark, sf_dir, "events")
    path, first = new_path(spark, "feed"), events.agg(F.min(F.to_date("ts"))).first()[0]
    late = f"to_date(ts) >= DATE '{first}' + INTERVAL 7 DAYS AND to_date(ts) < DATE '{first}' + INTERVAL 14 DAYS"
    _feed(spark, events, path, f"NOT ({late})")
    sql = 'SELECT day, COUNT(*) AS n FROM __source("feed") WHERE day >= __cursor_start() AND day < __cursor_end() GROUP BY day'
    model = Model("weekly", sql, "incremental", strategy="delete_insert", cursor="day", cursor_grain="day", batch_size=7, batch_concurrency=2, unaccounted_partition_policy="recover_empty")
    engine = _fresh(spark, "millrace_gaps", Project().add(Source("feed", path=path), model))
    _built(engine)
    _feed(spark, events, path, late)
    _built(engine)
    return engine.warehouse.read("weekly").withColumn("day", F.col("day").cast("string"))


@QUERIES.frame(
    "q_engine_history",
    """
    WITH r AS (SELECT user_id, event_type, epoch_us(ts) AS seen, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1),
         c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY seen) AS before FROM r),
         k AS (SELECT * FROM c WHERE before IS DISTINCT FROM event_type)
    SELECT user_id, event_type, seen AS since, lead(seen) OVER (PARTITION BY user_id ORDER BY seen) AS until FROM k
    """,
)
def engine_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every user did, as a historical snapshot model: the first half of the time, then the rest."""
    (events,) = tables_of(spark, sf_dir, "events")
    first_of = F.row_number().over(Window.partitionBy("user_id", "ts").orderBy("event_id"))
    rows = written(events.withColumn("_n", first_of).where("_n = 1").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("seen")), "seen")
    cut = sum(rows.agg(F.min("seen"), F.max("seen")).first()) // 2
    path = new_path(spark, "feed")
    project = Project().add(
        Source("feed", path=path),
        Model("did", 'SELECT * FROM __source("feed")', "snapshot", unique_key=("user_id",), snapshot_strategy="check", check_columns=("event_type",), observed_at="seen", historical_input=True, valid_from_column="since", valid_to_column="until"),
    )
    engine = _fresh(spark, "millrace_history", project)
    rows.where(F.col("seen") < cut).write.parquet(path)
    _built(engine)
    rows.where(F.col("seen") >= cut).write.mode("overwrite").parquet(path)
    _built(engine)
    return engine.warehouse.read("did").select("user_id", "event_type", "since", "until")


@QUERIES.frame("q_project_unit_test", "SELECT true AS passed, 1 AS actual_rows, 0 AS missing")
def project_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order with two lines gives one day; the models between run on the given rows."""
    engine = _engine(spark, sf_dir, "millrace_test")
    engine.prepare()
    orders = spark.sql("SELECT 1L AS o_orderkey, 7L AS o_custkey, 'F' AS o_orderstatus, TIMESTAMP_NTZ '2024-04-01 00:00:00' AS o_orderdate")
    lines = spark.sql("SELECT * FROM VALUES (1L, 2D, 8.5D), (1L, 1D, 8.5D) AS t(l_orderkey, l_quantity, l_extendedprice)")
    expected = spark.sql("SELECT DATE '2024-04-01' AS order_day, 1L AS n_orders, 3L AS quantity, 1700L AS cents")
    v = engine.test("daily_revenue", {("source", "orders"): orders, ("source", "lines"): lines}, expected, Interval(date(1900, 1, 1), date(2999, 12, 31)))
    return spark.createDataFrame([(v.passed, v.actual_rows, v.missing)], "passed boolean, actual_rows int, missing int")


_SELECTED = [
    ("+fact_orders", ["fact_orders", "function:is_kept", "source:lines", "source:orders", "stg_lines", "stg_orders"]),
    ("stg_lines+", ["daily_revenue", "fact_orders", "stg_lines"]),
    ("tag:mart", ["daily_revenue", "fact_orders"]),
    ("tag:mart,tag:daily", ["fact_orders"]),
    ("path:staging", ["stg_lines", "stg_orders"]),
    ("stg_orders~daily_revenue", ["daily_revenue", "fact_orders", "stg_orders"]),
    ("stg_*", ["stg_lines", "stg_orders"]),
    ("source:lines+", ["daily_revenue", "fact_orders", "source:lines", "stg_lines"]),
]


@QUERIES.frame("q_selectors", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{n}')" for s, nodes in _SELECTED for n in nodes) + ") t(selector, node)")
def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = shop(sf_dir)
    return spark.createDataFrame([(s, n) for s, _ in _SELECTED for n in project.select([s])], "selector string, node string")


@QUERIES.frame(
    "q_plan_actions",
    """
    SELECT * FROM (VALUES ('first', 'stg_orders', 'create', 'first run'), ('first', 'stg_lines', 'create', 'first run'), ('first', 'fact_orders', 'create', 'first run'), ('first', 'daily_revenue', 'create', 'first run'),
      ('same', 'stg_orders', 'skip', 'unchanged'), ('same', 'stg_lines', 'skip', 'unchanged'), ('same', 'fact_orders', 'skip', 'unchanged'), ('same', 'daily_revenue', 'increment', 'new rows'),
      ('edited', 'stg_orders', 'skip', 'unchanged'), ('edited', 'stg_lines', 'replace', 'query changed'), ('edited', 'fact_orders', 'replace', 'upstream changed'), ('edited', 'daily_revenue', 'increment', 'new rows')) t(run, model, action, reason)
    """,
)
def plan_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = shop(sf_dir)
    states = {n: state_of(project, m) for n, m in project.models.items()}
    edited = shop(sf_dir)
    line = edited.models["stg_lines"]
    edited.models["stg_lines"] = Model(line.name, line.sql + " WHERE l_quantity > 0", tags=line.tags, path=line.path)
    runs = (("first", project, {}, set()), ("same", project, states, set(states)), ("edited", edited, states, set(states)))
    rows = [(run, e.model, e.action, e.reason) for run, p, s, there in runs for e in plan(p, s, there)]
    return spark.createDataFrame(rows, "run string, model string, action string, reason string")


@QUERIES.frame("q_lineage", "SELECT * FROM (VALUES ('day', 'o.o_orderdate'), ('revenue', 'l.l_discount'), ('revenue', 'l.l_extendedprice'), ('n', '')) t(output, input)")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("o")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("l")
    frame = spark.sql("WITH p AS (SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM l) SELECT CAST(o_orderdate AS DATE) AS day, SUM(net) AS revenue, COUNT(*) AS n FROM o JOIN p ON l_orderkey = o_orderkey GROUP BY 1")
    rows = [(output, source) for output, sources in column_lineage(frame).items() for source in (sorted(sources) or [""])]
    return spark.createDataFrame(rows, "output string, input string")


_FAULTS = [
    ("SELECT nothing FROM region", "unknown column"),
    ("SELECT * FROM nowhere", "unknown relation"),
    ("SELECT r_name, COUNT(*) FROM region", "grouping"),
    ("SELECT upper(r_name, 1) FROM region", "arity"),
    ("SELECT r_regionkey FROM region a JOIN region b ON true", "ambiguous column"),
    ("SELECT 1 FROM region LIMIT -1", "limit"),
    ("SELECT 1 UNION SELECT 1, 2", "arity"),
    ("SELECT no_such(r_name) FROM region", "unknown function"),
]


@QUERIES.frame("q_semantic_checks", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, (_, k) in enumerate(_FAULTS)) + ") t(case_no, kind)")
def semantic_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/region.parquet").createOrReplaceTempView("region")
    rows = [(i, (check_statement(spark, sql) or ("none", ""))[0]) for i, (sql, _) in enumerate(_FAULTS)]
    return spark.createDataFrame(rows, "case_no int, kind string")


@QUERIES.frame("q_interval_coverage", "SELECT * FROM (VALUES (0, 10, 'complete'), (10, 15, 'known missing'), (15, 20, 'complete'), (20, 30, 'unaccounted'), (30, 40, 'complete')) t(low, high, state)")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = [Completion(Interval(0, 15), 1), Completion(Interval(10, 20), 2, True), Completion(Interval(15, 20), 3), Completion(Interval(30, 45), 1)]
    segments, _ = project_coverage(Interval(0, 40), done)
    return spark.createDataFrame([(s.interval.start, s.interval.end, s.state) for s in segments], "low int, high int, state string")


@QUERIES.frame(
    "q_compile",
    """
    SELECT * FROM (VALUES ('first', 'stg_orders', '', 7), ('first', 'stg_lines', '', 7), ('first', 'fact_orders', '', 7), ('first', 'daily_revenue', '', 7), ('first', 'broken', 'unknown column', 7), ('first', 'behind', 'upstream', 7), ('first', 'untrue', 'contract', 7), ('first', 'torn', 'syntax', 7),
      ('again', 'stg_orders', '', 0), ('again', 'stg_lines', '', 0), ('again', 'fact_orders', '', 0), ('again', 'daily_revenue', '', 0), ('again', 'broken', 'unknown column', 0), ('again', 'behind', 'upstream', 0), ('again', 'untrue', 'contract', 0), ('again', 'torn', 'syntax', 0)) t(run, model, fault, analysed)
    """,
)
def compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shop with four faulty models, compiled twice: nothing is analysed the second time."""
    project = shop(sf_dir).add(
        Model("broken", 'SELECT nothing FROM __ref("fact_orders")'),
        Model("behind", 'SELECT * FROM __ref("broken")'),
        Model("untrue", 'SELECT cents FROM __ref("fact_orders")', columns={"cents": "VARCHAR"}, contract=True),
        Model("torn", "SELECT 1 +"),
    )
    inputs = {f"source:{s.name}": spark.read.parquet(s.path).schema for s in project.sources.values()}
    compiler, rows = Compiler(spark), []
    for run in ("first", "again"):
        before = compiler.analysed
        found = compiler.compile(project, inputs)
        rows += [(run, c.model, c.fault or ("contract" if c.findings else ""), compiler.analysed - before) for c in found.values()]
    return spark.createDataFrame(rows, "run string, model string, fault string, analysed int")
