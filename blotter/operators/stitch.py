"""Stitching the inside intervals of long lines: by ranges of segments, then only across the ranges' ends.

Intervals of one line in one polygon are sorted inside ranges of ``RANGE`` segments, each range in a task of its own.
Every range yields its pieces; the only ones that can go on in a neighbouring range are its first, if it begins where the range does, and its last, if
it ends where the range does. One small row a range carries that to a running sum over the ranges, which numbers all pieces;
pieces that lie in one range are finished, and only those that cross a border between ranges are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 4096
NEAR = 1e-9


def stitch(inside: DataFrame, key: list[str], attrs: str = "_attrs", size: int = RANGE) -> DataFrame:
    """(key, attrs, piece, pts): the pieces of each key, numbered from 1 along the line, with their points.

    ``inside`` has the key, ``seg``, ``ta`` and ``tb`` (the share of the segment), ``a`` and ``b`` (its points there) and
    ``attrs``. Intervals that touch, in one segment or from the end of one to the start of the next, are one piece; its
    points are its ends and the line's own points between them.
    """
    ranged = inside.withColumn("_range", F.floor(F.col("seg") / size))
    group = [*key, "_range"]
    w = Window.partitionBy(*group).orderBy("seg", "ta")
    seg, tb = F.lag("seg").over(w), F.lag("tb").over(w)
    goes_on = ((seg == F.col("seg")) & (F.abs(tb - F.col("ta")) < NEAR)) | (
        (seg == F.col("seg") - 1) & (tb > 1 - NEAR) & (F.col("ta") < NEAR))
    numbered = ranged.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn(
        "_own", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Where a piece goes on inside one segment, another polygon cut it: that is no point of this piece.
    passed = F.coalesce((F.lead("seg").over(w) == F.col("seg")) & (F.lead("_new").over(w) == 0), F.lit(False))
    parts = numbered.withColumn("_passed", passed).groupBy(*group, "_own").agg(
        F.array_sort(F.collect_list(F.struct("seg", "ta", "tb", "a", "b", "_passed"))).alias("ivs"), F.first(attrs).alias(attrs))
    first, last = F.element_at("ivs", 1), F.element_at("ivs", -1)
    parts = parts.select(
        *group, "_own", attrs, F.concat(F.array(first["a"]), F.transform(F.filter("ivs", lambda v: ~v["_passed"]), lambda v: v["b"])).alias("pts"),
        ((first["seg"] == F.col("_range") * size) & (first["ta"] < NEAR)).alias("from_before"),
        ((last["seg"] == (F.col("_range") + 1) * size - 1) & (last["tb"] > 1 - NEAR)).alias("to_after"))

    ends = parts.groupBy(*group).agg(
        F.max("_own").alias("_n"), F.bool_or("from_before").alias("_open"), F.bool_or("to_after").alias("_on"))
    along = Window.partitionBy(*key).orderBy("_range")
    joined = F.coalesce(F.lag("_on").over(along) & F.col("_open") & (F.lag("_range").over(along) == F.col("_range") - 1), F.lit(False))
    ends = ends.withColumn("_joined", joined)
    # The last piece of a range goes on if the next range's first is joined to it.
    ends = ends.withColumn("_leads", F.coalesce(F.lead("_joined").over(along), F.lit(False)))
    before = F.sum(F.col("_n") - F.col("_joined").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("_base", before - F.col("_n"))

    parts = _same(parts, ends, group).withColumn("piece", (F.col("_base") + F.col("_own")).cast("int"))
    crosses = ((F.col("_own") == 1) & F.col("_joined")) | ((F.col("_own") == F.col("_n")) & F.col("_leads"))
    whole = parts.where(~crosses).select(*key, attrs, "piece", "pts")
    over = parts.where(crosses).groupBy(*key, "piece").agg(
        F.array_sort(F.collect_list(F.struct("_range", "pts"))).alias("ranges"), F.first(attrs).alias(attrs))
    # A range's first point is the last one of the range before it.
    tail = F.flatten(F.transform("ranges", lambda r, i: F.when(i == 0, r["pts"]).otherwise(F.slice(r["pts"], 2, F.size(r["pts"])))))
    return whole.unionByName(over.select(*key, attrs, "piece", tail.alias("pts")))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join in which a null key matches a null key."""
    right = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on: list[Column] = [left[k].eqNullSafe(right[f"_r{k}"]) for k in keys]
    return left.join(right, on).drop(*[f"_r{k}" for k in keys])
