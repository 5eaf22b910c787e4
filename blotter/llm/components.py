"""Connected components of large undirected graphs, by alternating star operations.

Every step is a join and an aggregation on node ids, so no component or neighbourhood is ever held by
one task: a node with many neighbours is one minimum in the aggregation and a splittable side of the
join. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .store import drop, stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Point each node's neighbours at the least node of its neighbourhood.

    ``edges`` are (a, b) with a > b. The large star moves the larger neighbours of a node, the small
    star the smaller ones and the node itself. A pair may come several times.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        moved = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("low"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        moved = moved.unionAll(least.select("a", F.col("low").alias("b")))
    return moved.where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id reachable from each node of ``edges`` (a, b), for nodes that are not roots.

    Edges may repeat and point either way; self-loops and nulls say nothing. No edges give no rows.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = stage(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "components")
    mark = None
    while True:
        seen = Observation()
        moved = _stars(_stars(edges, large=True), large=False).distinct().observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        before, edges = edges, stage(moved, "components")
        drop(before)
        new = seen.get  # of no rows it may be empty
        if new == mark:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        mark = new
