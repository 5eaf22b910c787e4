"""Running totals in a global order without moving all rows into one task.

``Window.orderBy(...)`` with no ``partitionBy`` sends every row to a single task. Here the input is
range-partitioned on the order keys and checkpointed with its partition number (so every later read
sees the same partitioning); each partition computes its own prefix sums, and the per-partition
totals (one row for each partition) are turned into offsets and broadcast back. There is one plan
for every input size. Sums of whole numbers are exact, so they do not depend on the partitions;
scale them afterwards rather than summing fractions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def running_total(df: DataFrame, value: str, order: Sequence[Column], out: str,
                  exclusive_out: str | None = None, partitions: int | None = None,
                  also: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows up to and including this one in ``order``.

    ``exclusive_out`` (optional) = the same sum over the rows strictly before (0 for the first).
    ``also`` maps further outputs to their values, summed alike. Ties in ``order`` land in the same range
    partition and are summed in an arbitrary but fixed order, like any row-frame window.
    ``partitions`` sets the number of ranges.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    staged = materialise(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_rt_pid", F.spark_partition_id())
    )
    sums = {out: value, **(also or {})}
    w = Window.partitionBy("_rt_pid").orderBy(*order)
    upto, before = (w.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    local = staged.withColumns({f"_rt_{o}": F.sum(v).over(upto) for o, v in sums.items()})
    if exclusive_out:
        local = local.withColumn("_rt_before", F.coalesce(F.sum(value).over(before), F.lit(0)))
    # One row for each partition: a single-task window here is bounded by the partition count.
    totals = staged.groupBy("_rt_pid").agg(*[F.sum(v).alias(f"_rt_total_{o}") for o, v in sums.items()])
    wp = Window.orderBy("_rt_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_rt_pid", *[
        F.coalesce(F.sum(f"_rt_total_{o}").over(wp), F.lit(0)).alias(f"_rt_offset_{o}") for o in sums])
    res = local.join(F.broadcast(offsets), "_rt_pid")
    res = res.withColumns({o: F.col(f"_rt_offset_{o}") + F.col(f"_rt_{o}") for o in sums})
    if exclusive_out:
        res = res.withColumn(exclusive_out, F.col(f"_rt_offset_{out}") + F.col("_rt_before"))
    return res.drop("_rt_pid", "_rt_before", *[f"_rt_{o}" for o in sums], *[f"_rt_offset_{o}" for o in sums])


def row_number_global(df: DataFrame, order: Sequence[Column], out: str = "ord") -> DataFrame:
    """1-based position of each row in the global ``order`` (a running count)."""
    ranked = running_total(df.withColumn("_rn_one", F.lit(1)), "_rn_one", order, out)
    return ranked.withColumn(out, F.col(out).cast("int")).drop("_rn_one")
