"""Hotspot maps: most frequent exact locations, one or several layers, chart-ready."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recode import colour_map
from ..functions.rules import (
    CATEGORY_COLOURS,
    DEFAULT_CATEGORY,
    LAYER_COLOURS,
    MAP_VIEW,
    POINT_SIZE_RANGE,
)
from ..functions.scales import in_view, size_scale
from ..operators.layers import union_layers
from ..operators.points import point_counts, points_from_coords, points_from_wkt, valid_points
from ..operators.topk import top_k_with_ties

WEAPONS = "Weapons/Explosives"


def top_locations(df: DataFrame, lon: str = "longitude", lat: str = "latitude", category: str = "category",
                  exclude: str | None = DEFAULT_CATEGORY, k: int = 100,
                  colours: Mapping[str, str] = CATEGORY_COLOURS,
                  view: tuple[float, float, float, float] = MAP_VIEW,
                  size_range: tuple[float, float] = POINT_SIZE_RANGE) -> DataFrame:
    """Top-k (with ties) exact points per category.

    Output: ``lon, lat, <category>, n, size, colour, in_view``. Missing, NaN and zero
    coordinates and the excluded category are removed before counting; the size scale is
    trained on the returned rows, including points outside the viewport.
    """
    pts = valid_points(df.select(lon, lat, category), lon, lat, drop_zero=True)
    if exclude is not None:
        pts = pts.where(F.col(category) != F.lit(exclude))
    pts = points_from_coords(pts, lon, lat)
    top = top_k_with_ties(point_counts(pts, "lon", "lat", [category]), "n", k)
    sized = size_scale(top, "n", "size", size_range)
    return sized.select(
        "lon", "lat", category, "n", "size",
        colour_map(category, colours).alias("colour"), in_view("lon", "lat", view).alias("in_view"),
    )


def layer_points(df: DataFrame, wkt_col: str, k: int = 100, drop_zero: bool = False) -> DataFrame:
    """One layer: parse WKT points, count per exact point (once, as a staged table), keep the top k with ties."""
    pts = points_from_wkt(df.select(wkt_col), wkt_col)
    if drop_zero:
        pts = valid_points(pts, "lon", "lat", drop_zero=True)
    return top_k_with_ties(point_counts(pts, "lon", "lat"), "n", k, staged=True)


def weapon_arrests(df: DataFrame, category: str = "category", value: str = WEAPONS) -> DataFrame:
    """Arrests in one category (the weapons category by default)."""
    return df.where(F.col(category) == F.lit(value))


def layered_hotspots(layers: Mapping[str, DataFrame], k: int = 100,
                     colours: Mapping[str, str] = LAYER_COLOURS,
                     view: tuple[float, float, float, float] = MAP_VIEW,
                     size_range: tuple[float, float] = POINT_SIZE_RANGE) -> DataFrame:
    """Several already-counted layers (``lon, lat, n``) under one size and colour scale.

    Output: ``series, lon, lat, n, size, colour, in_view``.
    """
    both = union_layers(layers, "series")
    sized = size_scale(both, "n", "size", size_range)
    return sized.select(
        "series", "lon", "lat", "n", "size",
        colour_map("series", colours).alias("colour"), in_view("lon", "lat", view).alias("in_view"),
    )


def weapons_vs_shootings(arrests: DataFrame, shootings: DataFrame, wkt_col: str = "new_georeferenced_column",
                         category: str = "category", k: int = 100, drop_zero: bool = False,
                         value: str = WEAPONS, shootings_wkt_col: str | None = None) -> DataFrame:
    """Top weapon-arrest points and top shooting points on one map."""
    return layered_hotspots({
        "Weapon Arrests": layer_points(weapon_arrests(arrests, category, value), wkt_col, k, drop_zero),
        "Shooting Incidents": layer_points(shootings, shootings_wkt_col or wkt_col, k, drop_zero),
    }, k)
