"""Tool-call linking, in DataFrame functions only: join calls with their results by identifier, order them
topologically, validate arguments against schemas, and serialise canonical JSON.

Calls have the columns conv_id, call_id, position, name, arguments (JSON text) and depends_on (call ids);
results have conv_id, call_id, position and content.

Cases: of calls, or results, that share an identifier the first by position (then by content) counts and
the others add to `repeats`; a call without a result, and a result without a call, are rows with that
status; a dependency that does not exist is an error of the call and does not delay it; calls on a cycle
and behind one have no level and an error; null or broken JSON, and JSON beyond the size of a variant, is an error
`json`, and such arguments are serialised as an array of that one text; a system's turns are neither calls nor results of a
dialogue and give no rows; identifiers that are null link with
nothing. No conversation is gathered in one task: all joins and sums are keyed by identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import scratch, written
from millrace.storage import new_path

#: For each function its parameters: (JSON type, whether required).
Schemas = dict[str, dict[str, tuple[str, bool]]]

#: Spark's names of a variant's type, for each JSON type.
VARIANT_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def first_of(rows: DataFrame, values: list[str]) -> DataFrame:
    """One row for each (conv_id, call_id): the least by position and content; `repeats` counts the others."""
    entry = F.struct("position", *values)
    found = rows.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(entry).alias("e"), (F.count("*") - 1).alias("repeats"))
    return found.select("conv_id", "call_id", "e.*", "repeats")


def argument_errors(schemas: Schemas) -> Column:
    """An array of the faults in `arguments` (parsed as `parsed`) of a call of `name`, in the schema's order."""
    errors = F.array(F.concat(F.lit("function:"), F.coalesce("name", F.lit("null"))))
    for function, parameters in schemas.items():
        faults = []
        for parameter, (kind, required) in parameters.items():
            value = F.try_variant_get("parsed", f"$.{parameter}", "variant")
            missing = F.lit(f"missing:{parameter}") if required else F.lit(None).cast("string")
            wrong = ~F.schema_of_variant(value).rlike(f"^(?:{VARIANT_TYPES[kind]})$")
            faults.append(F.when(value.isNull() | F.is_variant_null(value), missing).when(wrong, F.lit(f"type:{parameter}")))
        known = F.array(*(F.lit(p) for p in parameters))
        extra = F.transform(F.array_except(F.array_sort(F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))), known), lambda k: F.concat(F.lit("unknown:"), k))
        errors = F.when(F.col("name") == function, F.concat(F.array_compact(F.array(*faults)), extra)).otherwise(errors)
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, F.array(F.lit("json"))).otherwise(errors)


def levels(calls: DataFrame) -> DataFrame:
    """The topological level of every call: 0 without dependencies, else one more than the highest of them;
    null on or behind a cycle. Calls with at most one dependency each are chains, which are followed by
    doubling, in as many rounds as the logarithm of their length; otherwise levels are settled in rounds."""
    node = F.struct("conv_id", "call_id")
    nodes = calls.select("conv_id", "call_id", node.alias("node"), F.array_distinct(F.coalesce("depends_on", F.array().cast("array<string>"))).alias("depends_on"))
    edges = nodes.select("node", "conv_id", F.explode("depends_on").alias("call_id")).select("node", F.struct("conv_id", "call_id").alias("before"))
    edges = written(edges.join(nodes.select(F.col("node").alias("before")), "before", "left_semi").select("node", "before"), "call-edges")
    several = edges.groupBy("node").count().where("count > 1").limit(1).count() > 0
    if several:
        return settled_levels(nodes, edges)
    state = written(nodes.select("node").join(edges, "node", "left").select("node", "before", F.when(F.col("before").isNull(), 0).otherwise(1).cast("bigint").alias("level")), "call-levels")
    total = state.count()
    reach = 1
    while reach <= total and state.where("before IS NOT NULL").limit(1).count():
        jump = state.select(F.col("node").alias("before"), F.col("before").alias("next"), F.col("level").alias("more"))
        ended = state.where("before IS NULL")
        going = state.where("before IS NOT NULL").join(jump, "before").select("node", F.col("next").alias("before"), (F.col("level") + F.col("more")).alias("level"))
        state = written(ended.unionByName(going), "call-levels")
        reach *= 2
    return state.select("node.conv_id", "node.call_id", F.when(F.col("before").isNull(), F.col("level")).alias("level"))


def settled_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels of any acyclic graph: in each round the calls whose dependencies are all settled. There are as many
    rounds as levels, each over the calls that are still waiting; what is settled is added to one written table."""
    spark, waiting, level = nodes.sparkSession, edges, 0
    fresh = nodes.select("node").join(edges, "node", "left_anti").withColumn("level", F.lit(0).cast("bigint"))
    settled = new_path(spark, "call-levels")
    fresh = written(fresh, "call-settled")
    fresh.write.parquet(settled)
    while fresh.limit(1).count():
        level += 1
        touched = waiting.join(fresh.select(F.col("node").alias("before")), "before", "left_semi").select("node").distinct()
        waiting = written(waiting.join(fresh.select(F.col("node").alias("before")), "before", "left_anti"), "call-waiting")
        fresh = written(touched.join(waiting.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(level).cast("bigint")), "call-settled")
        fresh.write.mode("append").parquet(settled)
    done = spark.read.schema(fresh.schema).parquet(settled)
    return nodes.select("node").join(done, "node", "left").select("node.conv_id", "node.call_id", "level")


@scratch
def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, and per result without a call: status, level, faults and canonical JSON."""
    one = first_of(calls.withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>"))), ["name", "arguments", "depends_on"])
    answer = first_of(results, ["content"]).select("conv_id", "call_id", "content", F.col("position").alias("result_position"), F.col("repeats").alias("result_repeats"))
    level = levels(one)
    known = one.select("conv_id", "call_id", F.explode("depends_on").alias("needs"))
    lost = known.join(one.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("needs")).alias("lost"))
    both = one.join(level, ["conv_id", "call_id"], "left").join(lost, ["conv_id", "call_id"], "left").withColumn("is_call", F.lit(True)).join(answer.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    both = both.withColumn("parsed", F.try_parse_json("arguments"))
    faults = F.when(F.col("is_call").isNull(), F.array().cast("array<string>")).otherwise(
        F.concat(
            argument_errors(schemas),
            F.transform(F.coalesce("lost", F.array().cast("array<string>")), lambda x: F.concat(F.lit("dependency:"), x)),
            F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")),
        )
    )
    status = F.when(F.col("is_call").isNull(), "result without call").when(F.col("result_position").isNull(), "call without result").otherwise("linked")
    # A variant keeps an object's keys in order, so its JSON is canonical.
    arguments = F.coalesce(F.to_json("parsed"), F.to_json(F.array(F.col("arguments"))), F.lit("null"))
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    message = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), text(F.col("call_id")), F.lit(',"name":'), text(F.col("name")), F.lit(',"result":'), text(F.col("content")), F.lit("}"))
    return both.select(
        "conv_id",
        "call_id",
        status.alias("status"),
        "level",
        F.coalesce("position", "result_position").alias("position"),
        (F.coalesce("repeats", F.lit(0)) + F.coalesce("result_repeats", F.lit(0))).cast("bigint").alias("repeats"),
        F.array_join(faults, ",").alias("errors"),
        ((F.size(faults) == 0) & F.col("is_call").isNotNull()).alias("valid"),
        message.alias("message"),
    ).withColumn("valid", F.coalesce("valid", F.lit(False)))


#: What a turn of a conversation must bring to count as a call of `reply`.
REPLY = {"reply": {"text": ("string", True), "turn": ("integer", True)}}


def turn_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A dialogue as calls and results: a user's turn calls `reply`, the assistant's turn behind it is the result. A call
    depends on the call two turns before it, if there is one."""
    identifier = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    turns = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    asked = turns.where("role = 'user'")
    users = asked.select("conv_id", F.col("turn").alias("earlier")).distinct()
    calls = asked.withColumn("earlier", F.col("turn") - 2).join(users.withColumn("found", F.lit(True)), ["conv_id", "earlier"], "left")
    calls = calls.select(
        "conv_id",
        identifier(F.col("turn")).alias("call_id"),
        F.col("turn").alias("position"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct("text", "turn")).alias("arguments"),
        F.when(F.col("found"), F.array(identifier(F.col("earlier")))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    answers = turns.where("role = 'assistant'").select("conv_id", identifier(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return calls, answers


ORACLE = """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, min(struct_pack(t := text)).t AS text, count(*) - 1 AS repeats FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IN ('user', 'assistant') GROUP BY conv_id, turn, role
), u AS (SELECT * FROM turns WHERE role = 'user'), a AS (SELECT * FROM turns WHERE role = 'assistant'),
lv AS (
  SELECT conv_id, turn, CAST(0 AS BIGINT) AS level FROM u WHERE (conv_id, turn - 2) NOT IN (SELECT (conv_id, turn) FROM u)
  UNION ALL
  SELECT u.conv_id, u.turn, lv.level + 1 FROM lv JOIN u ON u.conv_id = lv.conv_id AND u.turn = lv.turn + 2
)
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id,
       CAST(coalesce(u.conv_id, a.conv_id) AS VARCHAR) || '-' || CAST(coalesce(u.turn, a.turn - 1) AS VARCHAR) AS call_id,
       CASE WHEN u.turn IS NULL THEN 'result without call' WHEN a.turn IS NULL THEN 'call without result' ELSE 'linked' END AS status,
       lv.level AS level, coalesce(u.turn, a.turn) AS position,
       CAST(coalesce(u.repeats, 0) + coalesce(a.repeats, 0) AS BIGINT) AS repeats,
       CASE WHEN u.turn IS NOT NULL AND u.text IS NULL THEN 'missing:text' ELSE '' END AS errors,
       u.turn IS NOT NULL AND u.text IS NOT NULL AS valid,
       '{"arguments":' || CASE WHEN u.turn IS NULL THEN 'null' WHEN u.text IS NULL THEN '{"turn":' || u.turn || '}' ELSE '{"text":' || CAST(to_json(u.text) AS VARCHAR) || ',"turn":' || u.turn || '}' END
       || ',"id":"' || coalesce(u.conv_id, a.conv_id) || '-' || coalesce(u.turn, a.turn - 1) || '","name":' || CASE WHEN u.turn IS NULL THEN 'null' ELSE '"reply"' END
       || ',"result":' || coalesce(CAST(to_json(a.text) AS VARCHAR), 'null') || '}' AS message
FROM u FULL JOIN a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
LEFT JOIN lv ON lv.conv_id = u.conv_id AND lv.turn = u.turn
"""
