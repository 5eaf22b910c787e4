"""Date parsing and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

US_DATE = "MM/dd/yyyy"


def as_date(df: DataFrame, col: str, fmt: str = US_DATE) -> Column:
    """Column ``col`` as DATE: no-op for dates, truncation for timestamps, parse for text.

    Text that does not parse becomes NULL (``try_to_date``), instead of failing the job.
    """
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(c)
    return F.try_to_date(c.cast("string"), fmt)


def month_of(col: Column | str) -> Column:
    """Month number 1-12 as INT (years are pooled)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.month(c).cast("int")
