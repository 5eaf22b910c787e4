"""Value maps with pass-through (CASE WHEN x = k THEN v ... ELSE x END)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def recode(col: Column | str, mapping: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Map listed values, keep the others (or use ``default``); NULL stays NULL.

    Compiles to a CASE chain, so it stays inside whole-stage codegen.
    """
    c = F.col(col) if isinstance(col, str) else col
    if not mapping:
        return c
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    if default is None:
        fallback = c
    elif isinstance(default, str):
        fallback = F.lit(default)
    else:
        fallback = default
    return expr.otherwise(fallback)


def colour_map(col: Column | str, colours: Mapping[str, str]) -> Column:
    """Named manual colour scale: key -> colour, unmapped keys -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    if not colours:
        return F.lit(None).cast("string")
    expr = None
    for k, v in colours.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(None).cast("string"))
