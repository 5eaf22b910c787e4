"""Clip lines to polygons: one output row per (line, polygon, connected piece inside).

Spark has no usable geometry type, so the intersection is expressed with joins on a regular
grid, all as DataFrame operations:

1. lines are exploded into segments and polygon rings into edges;
2. segments and edges meet in the cells of an adaptive grid that both pass (see ``grid``): segments are
   left-joined to edges on the cell, and one aggregate by segment gathers the parameters ``t`` of its
   crossings;
3. every segment is cut at its crossings; each interval lies wholly inside or wholly outside
   each polygon;
4. an interval's midpoint is looked up in the polygons' covers: cells wholly inside decide alone, in a border cell
   the edges of that cell do (all rings of all parts take part, so holes and multi-part polygons work);
5. inside intervals are stitched into pieces by ranges of segments (see ``stitch``).

All joins are equi-joins on a spatial key; which side is broadcast is the optimizer's choice from the
sizes it sees. Nothing is grouped by line before its pieces are known, so a long line is spread over
many tasks.

Conventions: planar coordinates (degrees treated as a plane); a piece that only touches the
boundary in a point is dropped; a line running along an edge is inside when the polygon lies
above it (half-open rule), so along a bottom edge it is kept, along a top edge dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import CITY_BBOX
from ..session import materialise
from .grid import EDGE, LEVELS, PAIRS, PLACE, Grid
from .points import DEGREE_CRS, crs_of
from .stitch import RANGE, stitch

EPS = 1e-12
MIN_INTERVAL = 1e-11
DEFAULT_CELL = 0.01


def _segments(lines: DataFrame, key: list[str]) -> DataFrame:
    pts = F.col("pts")
    seg = F.transform(
        F.sequence(F.lit(0), F.size(pts) - 2),
        lambda i: F.struct(
            i.alias("seg"),
            F.get(pts, i)["x"].alias("x1"), F.get(pts, i)["y"].alias("y1"),
            F.get(pts, i + 1)["x"].alias("x2"), F.get(pts, i + 1)["y"].alias("y2"),
        ),
    )
    return (
        lines.where(F.size(pts) >= 2)
        .select(*key, F.explode(seg).alias("s"))
        .select(*key, "s.*")
    )


def _edges(polygons: DataFrame, key: list[str]) -> DataFrame:
    ring = F.col("ring")
    n = F.size(ring)
    edge = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            F.get(ring, i)["x"].alias("ex1"), F.get(ring, i)["y"].alias("ey1"),
            F.get(ring, (i + 1) % n)["x"].alias("ex2"), F.get(ring, (i + 1) % n)["y"].alias("ey2"),
        ),
    )
    return (
        polygons.select(*key, F.explode("rings").alias("ring"))
        .where(F.size("ring") >= 2)
        .select(*key, F.explode(edge).alias("e"))
        .select(*key, "e.*")
        .where((F.col("ex1") != F.col("ex2")) | (F.col("ey1") != F.col("ey2")))
    )


def line_intersects_box(pts: Column | str, box: tuple[float, float, float, float] = CITY_BBOX) -> Column:
    """True when any part of the line lies in the box (xmin, ymin, xmax, ymax), borders included.

    Cheap bounding-box overlap first, then an exact segment test: a segment meets the box when
    their boxes overlap and the four box corners are not all strictly on one side of it.
    """
    xmin, ymin, xmax, ymax = box
    p = F.col(pts) if isinstance(pts, str) else pts
    xs = F.transform(p, lambda q: q["x"])
    ys = F.transform(p, lambda q: q["y"])
    bbox_overlap = (
        (F.array_min(xs) <= xmax) & (F.array_max(xs) >= xmin) & (F.array_min(ys) <= ymax) & (F.array_max(ys) >= ymin)
    )

    def seg_hits(i: Column) -> Column:
        a, b = F.get(p, i), F.get(p, i + 1)
        ax, ay, bx, by = a["x"], a["y"], b["x"], b["y"]
        overlap = (
            (F.least(ax, bx) <= xmax) & (F.greatest(ax, bx) >= xmin)
            & (F.least(ay, by) <= ymax) & (F.greatest(ay, by) >= ymin)
        )
        sides = [(bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
                 for cx, cy in ((xmin, ymin), (xmin, ymax), (xmax, ymin), (xmax, ymax))]
        straddle = (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)
        return overlap & straddle

    single = F.exists(p, lambda q: q["x"].between(xmin, xmax) & q["y"].between(ymin, ymax))
    exact = F.when(F.size(p) < 2, single).otherwise(F.exists(F.sequence(F.lit(0), F.size(p) - 2), seg_hits))
    return F.coalesce(bbox_overlap & exact, F.lit(False))


def _check_crs(lines: DataFrame, polygons: DataFrame) -> None:
    a = crs_of(lines, "pts") if "pts" in lines.columns else None
    b = crs_of(polygons, "rings") if "rings" in polygons.columns else None
    if a is not None and b is not None and a != b and not (a in DEGREE_CRS and b in DEGREE_CRS):
        raise ValueError(f"lines are in CRS {a}, polygons in CRS {b}")


def clip_lines(lines: DataFrame, polygons: DataFrame, line_key: Sequence[str] = ("way_id",),
               poly_key: Sequence[str] = ("name",), cell: float = DEFAULT_CELL,
               pairs: int = PAIRS, levels: int = LEVELS, segments: int = RANGE) -> DataFrame:
    """Intersect lines (``pts``) with polygons (``rings``).

    Rows of ``polygons`` with the same ``poly_key`` are the parts of one polygon. A line is identified
    by ``line_key``, its ``part`` (if there is such a column) and its points; rows that agree in these are
    one line. Returns the other columns of both inputs (of the polygons: those of one part, without
    ``part``) plus ``piece`` (1, 2, ... per line and polygon, along the line) and ``pts``, the ordered points
    of that piece. ``cell`` is the size of the grid's cells in coordinate units; cells in which more than ``pairs`` pairs of a
    segment and an edge meet are split, at most ``levels`` times. ``segments`` of a line are stitched in one task.
    """
    _check_crs(lines, polygons)
    pk = [f"_pk{i}" for i in range(len(poly_key))]
    parts = [F.col("part").cast("string")] if "part" in lines.columns else []
    line_cols = [c for c in lines.columns if c != "pts"]
    line_id = F.struct(*[F.col(c) for c in line_key], *parts, F.xxhash64("pts").alias("_shape"))
    L = lines.select(line_id.alias("_line"), F.struct(*line_cols).alias("_attrs"), "pts")
    P = polygons.select(*[F.col(c).alias(a) for c, a in zip(poly_key, pk)], "rings")

    segs = _segments(L, ["_line", "_attrs"])
    # Used several times below: computed once, with its lineage cut.
    edges = materialise(_edges(P, pk))
    grid = Grid(segs, edges, cell, pairs, levels)

    # 2. cut points of every segment: one scan of the lines, one shuffle by segment
    sc = grid.place(segs, ["x1", "y1", "x2", "y2"], ["_line", "seg"])
    ec = grid.place(edges.select(*EDGE), EDGE, None)
    rx, ry = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sx, sy = F.col("ex2") - F.col("ex1"), F.col("ey2") - F.col("ey1")
    qx, qy = F.col("ex1") - F.col("x1"), F.col("ey1") - F.col("y1")
    d = rx * sy - ry * sx
    t = F.try_divide(qx * sy - qy * sx, d)
    u = F.try_divide(qx * ry - qy * rx, d)
    crossing = (t > EPS) & (t < 1 - EPS) & (u >= -EPS) & (u <= 1 + EPS)
    seg_cols = ["_line", "seg", "x1", "y1", "x2", "y2"]
    with_cuts = (
        sc.join(ec, [*PLACE, "_salt"], "left")
        .groupBy(*seg_cols)
        .agg(F.collect_set(F.when(crossing, F.round(t, 12))).alias("ts"), F.first("_attrs").alias("_attrs"))
    )

    # 3. cut every segment into intervals
    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.col("ts"))))
    iv = F.transform(F.sequence(F.lit(0), F.size(ts) - 2),
                     lambda i: F.struct(F.get(ts, i).alias("ta"), F.get(ts, i + 1).alias("tb")))
    intervals = (
        with_cuts.select(*seg_cols, "_attrs", F.explode(iv).alias("iv"))
        .select(*seg_cols, "_attrs", "iv.ta", "iv.tb")
        .where(F.col("tb") - F.col("ta") > MIN_INTERVAL)
    )
    tm = (F.col("ta") + F.col("tb")) / 2.0
    intervals = intervals.withColumn("mx", F.col("x1") + tm * rx).withColumn("my", F.col("y1") + tm * ry)

    # 4. the polygons' cover: only the edges of a midpoint's own border cell are met
    near = grid.looked_up(intervals, "mx", "my", ["_line", "seg"]).join(grid.cover(edges, pk), [*PLACE, "_salt"])
    change = Grid.changes(F.col("mx"), F.col("my"), F.col("_cx"), F.col("_cy"))
    inside = (
        near.select(*seg_cols, "ta", "tb", *pk, "_attrs", change.alias("_change"))
        .where("_change > 0")
        .groupBy(*seg_cols, "ta", "tb", *pk)
        .agg(F.sum("_change").alias("_hits"), F.first("_attrs").alias("_attrs"))
        .where(F.col("_hits") % 2 == 1)
    )

    # 5. stitch consecutive inside intervals of the same line and polygon into pieces
    def at(tc: str) -> Column:
        # "+ 0.0" folds a negative zero into 0.0
        return F.struct((F.col("x1") + F.col(tc) * rx + 0.0).alias("x"), (F.col("y1") + F.col(tc) * ry + 0.0).alias("y"))

    pieces = stitch(inside.select("_line", *pk, "seg", "ta", "tb", at("ta").alias("a"), at("tb").alias("b"), "_attrs"),
                    ["_line", *pk], "_attrs", segments)

    # attributes of the polygons: one row for each key
    poly_cols = [c for c in polygons.columns if c not in ("rings", "part")]
    poly_attrs = polygons.groupBy(*[F.col(c).alias(a) for c, a in zip(poly_key, pk)]).agg(
        F.first(F.struct(*poly_cols)).alias("_poly"))
    out = _join_null_safe(pieces.select("_attrs", *pk, "piece", "pts"), poly_attrs, pk)
    return out.select(*[F.col("_poly")[c].alias(c) for c in poly_cols], *[F.col("_attrs")[c].alias(c) for c in line_cols],
                      "piece", "pts")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join in which a null key matches a null key."""
    right = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = [left[k].eqNullSafe(right[f"_r{k}"]) for k in keys]
    return left.join(right, on).drop(*[f"_r{k}" for k in keys])
