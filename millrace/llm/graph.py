"""Connected components of an edge table, by hooking every node to its least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of the edges (a, b); the root is the least id of the component.

    In each round every node takes its least neighbour as parent, parents are followed to their roots by
    doubling, and the edges between different roots remain. Each round at least halves the nodes that still have edges.
    Hot nodes are pre-aggregated before the shuffle; joins on a hot root have one row on the other side."""
    current = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mapping = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "parents")
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = written(parent.join(up, "root").select("id", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "parents")
            parent = jumped.select("id", "root")
            if jumped.where("moved").limit(1).count() == 0:
                break
        if mapping is None:
            mapping = parent
        else:
            top = parent.select(F.col("id").alias("root"), F.col("root").alias("above"))
            mapping = written(mapping.join(top, "root", "left").select("id", F.coalesce("above", "root").alias("root")), "roots")
        a, b = parent.select(F.col("id").alias("a"), F.col("root").alias("ra")), parent.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        rest = current.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        current = written(rest, "edges")
        if current.limit(1).count() == 0:
            return mapping
