"""Top-k by a count with ties kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


def top_k_threshold(df: DataFrame, n: str, k: int):
    """Scalar subquery: the k-th largest value of ``n`` (or the smallest, if fewer rows)."""
    return df.select(n).orderBy(F.col(n).desc_nulls_last()).limit(k).agg(F.min(n)).scalar()


def top_k_with_ties(df: DataFrame, n: str = "n", k: int = 100, staged: bool = False) -> DataFrame:
    """Rows whose ``n`` is at least the k-th largest ``n``: k rows plus every tie.

    With ``staged`` the rows are computed once, now, as a table that the threshold, the filter and any scale trained on
    the result all read; else the plan stays lazy and computes them for each. Plan: each partition keeps its own top k values of ``n`` (one column), only those reach a
    single task to find the threshold (at most k x partitions values), and the threshold is
    then applied as a plain distributed filter. No row is dropped because of skew or ties.
    """
    if k <= 0:
        return df.limit(0)
    if staged:
        df = stage_table(df, "top-k")
    return df.where(F.col(n) >= top_k_threshold(df, n, k))
