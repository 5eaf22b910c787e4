"""Chart scales computed as data: size, viewport flag, axis censoring, palettes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import MAP_VIEW, POINT_SIZE_RANGE


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def size_scale(df: DataFrame, n: str = "n", out: str = "size",
               size_range: tuple[float, float] = POINT_SIZE_RANGE) -> DataFrame:
    """Area scale: ``lo + (hi-lo) * sqrt((n-min)/(max-min))`` trained on all rows of ``df``.

    min and max come from one scalar subquery (one aggregate; no join, no single-partition
    window).
    When every value is equal the rescaled value is the midpoint 0.5.
    """
    limits = df.select(F.struct(F.min(n).alias("lo"), F.max(n).alias("hi"))).scalar()
    lo_n, hi_n = limits["lo"], limits["hi"]
    lo, hi = size_range
    span = hi_n - lo_n
    x = F.col(n).cast("double")
    rescaled = F.when(F.col(n).isNull(), F.lit(None).cast("double")).when(
        span == 0, F.lit(0.5)).otherwise(F.try_divide(x - lo_n, span.cast("double")))
    return df.withColumn(out, F.lit(float(lo)) + F.lit(float(hi - lo)) * F.sqrt(rescaled))


def in_view(lon: Column | str = "lon", lat: Column | str = "lat",
            view: tuple[float, float, float, float] = MAP_VIEW) -> Column:
    """True when the point lies inside the viewport (xmin, xmax, ymin, ymax), borders included."""
    xmin, xmax, ymin, ymax = view
    inside = _c(lon).between(xmin, xmax) & _c(lat).between(ymin, ymax)
    return F.coalesce(inside, F.lit(False))


def censor(y: Column | str, limits: tuple[float, float] | None) -> Column:
    """Axis limits: values outside [lo, hi] become NULL. ``None`` keeps everything."""
    c = _c(y)
    if limits is None:
        return c
    lo, hi = limits
    return F.when(c.between(lo, hi), c)


def palette_by_order(df: DataFrame, key: str, palette: Sequence[str], out: str = "colour") -> DataFrame:
    """Unnamed manual palette: the i-th smallest distinct key gets the i-th colour.

    ``df`` is a chart table (one row per key). The key ranks come from the sorted distinct keys;
    keys beyond the palette get NULL.
    """
    from ..operators.running import row_number_global

    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    ranked = row_number_global(keys, [F.col(key).asc()], "_rank")
    colours = F.array(*[F.lit(c) for c in palette])
    ranked = ranked.select(key, F.try_element_at(colours, F.col("_rank").cast("int")).alias(out))
    return df.join(ranked, on=key, how="left")
