"""Shares: within a group, of the grand total, filled stacks and level order.

Inputs are count tables (one row per key combination), never raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import row_number_global


SCORE_DIGITS = 9


def _cols(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def share_within(df: DataFrame, group: Sequence[str] | str, n: str = "n", out: str = "percent") -> DataFrame:
    """``100 * n / sum(n)`` over the rows of the same group."""
    w = Window.partitionBy(*_cols(group))
    return df.withColumn(out, F.lit(100.0) * F.col(n) / F.sum(n).over(w))


def share_of_total(df: DataFrame, n: str = "n", out: str = "percent") -> DataFrame:
    """``n / sum(n) * 100`` over the whole table.

    The total is a scalar subquery (one partial+final aggregate), not a window without
    partitioning, so no task ever holds the whole table.
    """
    total = df.select(F.sum(n)).scalar()
    return df.withColumn(out, F.col(n) / total.cast("double") * F.lit(100.0))


def stack_fill(df: DataFrame, group: Sequence[str] | str, key: str, value: str = "percent") -> DataFrame:
    """Bars stacked to 1 per group: ``ymin``, ``ymax``, ``ymid`` (label position).

    Each value is divided by its group's sum; stacking starts from the last level of ``key``
    (descending order, NULL level first), so the first level ends on top. Any value
    proportional to the counts gives the same stack; integer counts make the sums exact.
    """
    g = _cols(group)
    frac = F.col(value) / F.sum(value).over(Window.partitionBy(*g))
    w = Window.partitionBy(*g).orderBy(F.col(key).desc_nulls_first())
    out = df.withColumn("_frac", frac)
    out = out.withColumn("ymax", F.sum("_frac").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn("ymin", F.lag("ymax", 1, 0.0).over(w))
    out = out.withColumn("ymid", (F.col("ymin") + F.col("ymax")) / 2.0)
    return out.drop("_frac")


def reorder_levels(df: DataFrame, group: str, value: str, out: str = "ord", descending: bool = True) -> DataFrame:
    """Display order of ``group``: ascending mean of ``-value`` (or ``value``), ties by name.

    Adds ``out`` (1 = first). One score per group is computed by a hash aggregate; ranks are
    a distributed running count over the scores. Scores are rounded to ``SCORE_DIGITS``
    decimals first, so groups whose means are equal up to floating-point summation noise
    count as ties and are ordered by name, whatever order the rows were summed in.
    """
    mean = F.avg(-F.col(value)) if descending else F.avg(F.col(value))
    score = F.round(mean, SCORE_DIGITS)
    scores = df.groupBy(group).agg(score.alias("_score"))
    ranked = row_number_global(scores, [F.col("_score").asc_nulls_last(), F.col(group).asc_nulls_last()], out)
    return df.join(ranked.select(group, out), on=group, how="left")
