"""Several point layers drawn under one colour scale and one size scale."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .points import assert_same_crs


def label_series(df: DataFrame, name: str, col: str = "series") -> DataFrame:
    """Constant series label for every row of a layer."""
    return df.withColumn(col, F.lit(name))


def union_layers(layers: Mapping[str, DataFrame], col: str = "series",
                 coords: tuple[str, str] | None = ("lon", "lat")) -> DataFrame:
    """Label each layer with its name and stack them by column name (no shuffle).

    When ``coords`` are given, the layers must carry the same CRS tag.
    """
    if not layers:
        raise ValueError("no layers")
    if coords:
        assert_same_crs(*[(df, c) for df in layers.values() for c in coords if c in df.columns])
    labelled = [label_series(df, name, col) for name, df in layers.items()]
    return reduce(lambda a, b: a.unionByName(b), labelled)
