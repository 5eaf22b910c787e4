"""Chart label text and label geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import MONTH_ABBREVIATIONS, SHORT_SCALE


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def month_label(month: Column | str) -> Column:
    """1 -> 'Jan' ... 12 -> 'Dec'; anything else NULL. Locale independent."""
    names = F.array(*[F.lit(m) for m in MONTH_ABBREVIATIONS])
    return F.try_element_at(names, _c(month).cast("int"))


def round_half_even(x: Column | str, digits: int = 0) -> Column:
    """Round with ties to even (banker's rounding)."""
    return F.bround(_c(x), digits)


def shortest_number(x: Column | str) -> Column:
    """Double as the shortest text, with a trailing '.0' removed (12.0 -> '12')."""
    return F.regexp_replace(_c(x).cast("string"), r"\.0$", "")


def percent_label(p: Column | str, digits: int = 1) -> Column:
    """Percent value -> '12%', '2.2%', '33.3%' (half-even rounding to ``digits``)."""
    return F.concat(shortest_number(F.bround(_c(p), digits)), F.lit("%"))


def fraction_percent_label(x: Column | str, accuracy: float = 1.0) -> Column:
    """Fraction -> percent text, e.g. 0.25 -> '25%' (axis labels of a filled stack)."""
    d = _decimals(accuracy)
    return F.concat(F.format_string(f"%.{d}f", F.bround(_c(x) * 100.0, d)), F.lit("%"))


def _decimals(accuracy: float) -> int:
    return max(0, -int(math.floor(math.log10(accuracy) + 1e-9)))


def short_scale_label(x: Column | str, accuracy: float = 0.1) -> Column:
    """Number with K/M/B/T suffix: 22500 -> '22.5K', 950 -> '950.0', 1.5e6 -> '1.5M'."""
    c = _c(x).cast("double")
    d = _decimals(accuracy)
    ax = F.abs(c)
    scaled = None
    suffix = None
    for threshold, sfx in reversed(SHORT_SCALE):  # largest threshold first
        cond = ax >= F.lit(threshold)
        scaled = F.when(cond, c / F.lit(threshold)) if scaled is None else scaled.when(cond, c / F.lit(threshold))
        suffix = F.when(cond, F.lit(sfx)) if suffix is None else suffix.when(cond, F.lit(sfx))
    scaled = scaled.otherwise(c)
    suffix = suffix.otherwise(F.lit(""))
    return F.concat(F.format_string(f"%.{d}f", F.bround(scaled, d)), suffix)


def integer_label(x: Column | str) -> Column:
    """Number truncated to INT and shown as text; out of INT range -> NULL."""
    return as_integer(x).cast("string")


def as_integer(x: Column | str) -> Column:
    """Cast to INT, truncating toward zero; values out of range become NULL."""
    return _c(x).try_cast("int")


def flip_angle(angle: Column | str) -> Column:
    """Keep donut labels upright: angles below -90 are turned by 180 degrees."""
    a = _c(angle)
    return F.when(a < -90, a + 180).otherwise(a)


def flip_hjust(angle: Column | str) -> Column:
    """Justification that goes with :func:`flip_angle`: 1 for flipped labels, else 0."""
    return F.when(_c(angle) < -90, F.lit(1)).otherwise(F.lit(0))
