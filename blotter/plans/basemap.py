"""Base map: named districts and the main roads clipped to them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recode import recode
from ..functions.rules import BOROUGH_ALIASES, BOROUGH_COUNTIES, CITY_BBOX, ROAD_CLASSES
from ..operators.clip import DEFAULT_CELL, clip_lines, line_intersects_box
from ..sources.geo import BOX, in_box


def named_areas(polygons: DataFrame, name_col: str = "name", keep: Sequence[str] = BOROUGH_COUNTIES,
                aliases: Mapping[str, str] = BOROUGH_ALIASES, out: str = "borough_name") -> DataFrame:
    """Polygons whose name is listed, with a display name (alias or the name itself)."""
    return polygons.where(F.col(name_col).isin(*keep)).withColumn(out, recode(name_col, aliases))


def main_roads(lines: DataFrame, classes: Sequence[str] = ROAD_CLASSES,
               box: tuple[float, float, float, float] = CITY_BBOX, tag: str = "highway") -> DataFrame:
    """Lines tagged with one of ``classes`` that reach into ``box`` (xmin, ymin, xmax, ymax).

    Where the lines carry their boxes (a clustered table), these are compared first, by the scan.
    """
    if set(BOX) <= set(lines.columns):
        lines = lines.where(in_box(box))
    return lines.where(F.col(tag).isin(*classes)).where(line_intersects_box("pts", box))


def base_map(polygons: DataFrame, lines: DataFrame, name_col: str = "name",
             keep: Sequence[str] = BOROUGH_COUNTIES, aliases: Mapping[str, str] = BOROUGH_ALIASES,
             classes: Sequence[str] = ROAD_CLASSES, box: tuple[float, float, float, float] = CITY_BBOX,
             cell: float = DEFAULT_CELL, line_key: Sequence[str] = ("way_id",),
             poly_key: Sequence[str] = ("name",)) -> DataFrame:
    """Roads clipped to the named districts: ``borough_name, highway, way_id, (part,) piece, pts``.

    Parts of a district are one district; parts of a road are clipped each on its own.
    """
    areas = named_areas(polygons, name_col, keep, aliases).select(*poly_key, "borough_name", "rings")
    part = ["part"] if "part" in lines.columns else []
    roads = main_roads(lines, classes, box).select(*line_key, *part, "highway", "pts")
    clipped = clip_lines(roads, areas, line_key, poly_key, cell)
    return clipped.select("borough_name", "highway", *line_key, *part, "piece", "pts")
