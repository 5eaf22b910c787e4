"""Counting operators: counts per key, per month, distinct values.

All of them are hash aggregates with a partial (map-side) stage, so a hot key that holds a
large share of the rows is reduced to one row per input partition before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import US_DATE, as_date, month_of


def count_by(df: DataFrame, keys: Sequence[str] | str, name: str = "n") -> DataFrame:
    """One row per key combination (NULL is its own group) with its row count."""
    cols = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def monthly_counts(df: DataFrame, date_col: str, name: str = "total",
                   date_format: str = US_DATE) -> DataFrame:
    """Rows per calendar month 1-12 (all years pooled), months ascending, NULL month last."""
    month = month_of(as_date(df, date_col, date_format))
    counts = df.select(month.alias("month")).groupBy("month").agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.col("month").asc_nulls_last())


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column, NULL included."""
    return df.select(col).distinct()
