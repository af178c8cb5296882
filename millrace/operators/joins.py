"""Joins that the engine has no operator for, or none without a limit: as-of, range, hierarchical and recursive."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.storage import written


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], bucket: Column | None = None) -> DataFrame:
    """Every left row with `values` of the latest right row of the same keys whose time is not after its own,
    nulls if there is none. Where several right rows share that time, the greatest values count.

    Both sides are laid in one sequence per key, in which the last right row is carried on: one shuffle,
    no pair of rows is ever built. A hot key is cut by `bucket`, a monotonous function of the column `_time`
    (date_trunc, say): rows are carried within buckets, and what a bucket ends with is carried into those
    after it, which takes one row per bucket."""
    names = [f.name for f in left.schema.fields]
    kinds = dict(right.dtypes)
    entry = F.struct(*(F.col(v) for v in values))
    kind = "struct<" + ",".join(f"`{v}`:{kinds[v]}" for v in values) + ">"
    a = left.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(kind).alias("_value"))
    nothing = F.lit(None).cast(left.select(F.struct(*names).alias("r")).schema["r"].dataType)
    b = right.where(F.col(right_time).isNotNull()).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(right_time).alias("_time"), F.lit(0).alias("_side"), nothing.alias("_row"), entry.alias("_value"))
    columns = [f"_k{i}" for i in range(len(keys))]
    both = a.unionByName(b).withColumns({f"_{c}": F.col(c) for c in columns})
    order = [F.col("_time").asc_nulls_first(), "_side", F.col("_value").asc_nulls_first()]
    if bucket is None:
        carried = both.withColumn("_found", F.last("_value", True).over(Window.partitionBy(*columns).orderBy(*order)))
    else:
        both = both.withColumn("_bucket", bucket)
        inside = both.withColumn("_found", F.last("_value", True).over(Window.partitionBy(*columns, "_bucket").orderBy(*order)))
        ends = b.withColumn("_bucket", bucket).groupBy(*columns, "_bucket").agg(F.max(F.struct("_time", "_value"))["_value"].alias("_end"))
        starts = both.select(*columns, "_bucket").distinct().join(ends, [*columns, "_bucket"], "left")
        before = Window.partitionBy(*columns).orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.withColumn("_carry", F.last("_end", True).over(before)).drop("_end")
        same = [inside[c].eqNullSafe(starts[c]) for c in (*columns, "_bucket")]
        carried = inside.join(starts, reduce(and_, same), "left").withColumn("_found", F.coalesce("_found", "_carry"))
    # A left row without a time, or with a null key, matches nothing.
    known = F.col("_time").isNotNull()
    for c in columns:
        known = known & F.col(f"_{c}").isNotNull()
    out = carried.where("_side = 1")
    return out.select("_row.*", *(F.when(known, F.col(f"_found.{v}")).alias(v) for v in values))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs where low <= point < high, and the keys agree. Points and ranges meet by cells of `width`, so the join is an
    equi-join and no side is compared whole; a range is repeated once for each cell that it touches."""
    keys = keys or []
    a = points.withColumn("_cell", F.floor(F.col(point) / width))
    cells = F.when(F.col(low) < F.col(high), F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    b = ranges.withColumn("_cell", F.explode(cells))
    joined = a.join(b, ["_cell", *keys])
    return joined.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_cell")


def hierarchy(edges: DataFrame, node: str, parent: str, separator: str = "/", most_levels: int = 100) -> DataFrame:
    """For each node its level (roots 1), its root and the path from the root. Nodes on a cycle, or under one, are not reached.

    The walk goes level by level, each written before the next: a join per level of the tree, not per node."""
    kind = dict(edges.dtypes)[node]
    at = edges.select(F.col(node).alias("_node"), F.col(parent).alias("_parent"))
    level = at.where("_parent IS NULL").select("_node", F.col("_node").alias("root"), F.lit(1).alias("level"), F.concat(F.lit(separator), F.col("_node").cast("string")).alias("path"))
    found = level
    for depth in range(2, most_levels + 2):
        above = level.select(F.col("_node").alias("_parent"), "root", F.col("path").alias("_above"))
        level = at.join(above, "_parent").select("_node", "root", F.lit(depth).alias("level"), F.concat("_above", F.lit(separator), F.col("_node").cast("string")).alias("path"))
        level = written(level, "hierarchy")
        if level.limit(1).count() == 0:
            break
        if depth > most_levels:
            raise ValueError(f"the hierarchy is deeper than {most_levels} levels")
        found = found.unionByName(level)
    return found.select(F.col("_node").cast(kind).alias(node), "level", "root", "path")


def recursion(spark: SparkSession, statement: str) -> DataFrame:
    """The rows of a WITH RECURSIVE statement, however many they are. The engine fails beyond a million rows, or whatever
    number its session holds when the statement runs. So it runs in a clone of the session without that limit, with the same
    views and settings, and its rows are written. The session's limit of levels stays: endless recursion is an error."""
    own = spark._jsparkSession.cloneSession()
    own.conf().set("spark.sql.cteRecursionRowLimit", "-1")
    return written(DataFrame(own.sql(statement), spark), "recursion")
