"""The adaptive grid, the polygons' covers and the stitching by ranges, against the plain versions."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from blotter.operators import clip
from blotter.operators.grid import EDGE, PLACE, Grid
from blotter.operators.stitch import stitch
from test_clip import PT, _brute_clip, _pieces, ln


def star(rng, x, y, n, low=0.3, high=1.0):
    """A ring of n corners around (x, y), of uneven radius."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + math.cos(a) * (r := rng.uniform(low, high)), y + math.sin(a) * r) for a in turns]


@pytest.fixture(scope="module")
def plain():
    rng = random.Random(11)
    polys = [(f"p{i}", [star(rng, rng.uniform(0, 4), rng.uniform(0, 3), 40)]) for i in range(12)]
    polys += [("holed", [star(rng, 2, 2, 60, 0.8, 1.4), star(rng, 2, 2, 25, 0.1, 0.5)])]
    polys += [("crowd", [star(rng, 1.03, 1.04, 120, 0.01, 0.06)])]  # many edges in one cell
    lines = [(i, [(rng.uniform(-1, 5), rng.uniform(-1, 4)) for _ in range(rng.randint(2, 9))]) for i in range(30)]
    lines += [(100 + i, [(1.03 + rng.uniform(-0.08, 0.08), 1.04 + rng.uniform(-0.08, 0.08)) for _ in range(12)]) for i in range(12)]
    return lines, polys


@pytest.fixture(scope="module")
def frames(spark, plain):
    lines, polys = plain
    return (spark.createDataFrame([(i, "r", ln(*p)) for i, p in lines], f"way_id long, highway string, pts array<{PT}>"),
            spark.createDataFrame([(n, [ln(*r) for r in rings]) for n, rings in polys], f"name string, rings array<array<{PT}>>"))


@pytest.fixture(scope="module")
def want(plain):
    return _brute_clip(*plain)


@pytest.mark.parametrize("how", [{}, {"pairs": 60}, {"pairs": 5, "levels": 1, "segments": 2}])
def test_clip_equals_brute_force_however_cells_are_split(frames, want, how):
    """Whole cells; several levels; one level and a salt beyond it, stitched by ranges of two segments."""
    assert _pieces(clip.clip_lines(*frames, cell=0.25, **how)) == want


def _edges(polys):
    return clip._edges(polys, ["name"])


def _segments(lines):
    return clip._segments(lines, ["way_id"])


def test_crowded_cells_are_split_until_few_pairs_meet(spark):
    """20,000 edges and 20,000 segments in one cell: no cell keeps more pairs than allowed, no crossing is lost."""
    rng = random.Random(4)
    short = lambda n, s: [(x := rng.random(), y := rng.random(), x + rng.uniform(-s, s), y + rng.uniform(-s, s)) for _ in range(n)]
    segs = spark.createDataFrame([(i, *r) for i, r in enumerate(short(20_000, 0.003))], "seg long, x1 double, y1 double, x2 double, y2 double")
    edges = spark.createDataFrame([(i, *r) for i, r in enumerate(short(20_000, 0.003))], "e long, ex1 double, ey1 double, ex2 double, ey2 double")
    grid = Grid(segs, edges, cell=4.0, pairs=100_000)
    s, e = grid.place(segs, ["x1", "y1", "x2", "y2"], ["seg"]), grid.place(edges, EDGE, None)
    at = [*PLACE, "_salt"]
    both = s.groupBy(*at).agg(F.count("*").alias("s")).join(e.groupBy(*at).agg(F.count("*").alias("e")), at)
    sizes = [r.s * r.e for r in both.collect()]
    assert max(sizes) <= 100_000 and len(sizes) > 100
    cross = ("((x2-x1)*(ey1-y1)-(y2-y1)*(ex1-x1)) * ((x2-x1)*(ey2-y1)-(y2-y1)*(ex2-x1)) < 0 AND "
             "((ex2-ex1)*(y1-ey1)-(ey2-ey1)*(x1-ex1)) * ((ex2-ex1)*(y2-ey1)-(ey2-ey1)*(x2-ex1)) < 0")
    got = s.join(e, at).where(cross).select("seg", "e").distinct().count()
    near = lambda df, x, y: df.selectExpr("*", f"floor({x} / 0.01) AS ix", f"floor({y} / 0.01) AS iy")
    # A plain join on fixed small cells around each edge's first point.
    around = near(edges, "ex1", "ey1").withColumn("ix", F.explode(F.expr("sequence(ix - 1, ix + 1)"))).withColumn(
        "iy", F.explode(F.expr("sequence(iy - 1, iy + 1)")))
    assert got == near(segs, "x1", "y1").join(around, ["ix", "iy"]).where(cross).select("seg", "e").distinct().count() > 0


def test_lines_through_one_point_are_salted(spark):
    """Splitting cannot part lines that share a point: these cells' pairs are dealt to several tasks."""
    turn = [2 * math.pi * i / 300 for i in range(300)]
    segs = spark.createDataFrame([(i, 0.3, 0.3, 0.3 + math.cos(a), 0.3 + math.sin(a)) for i, a in enumerate(turn)], "seg long, x1 double, y1 double, x2 double, y2 double")
    edges = spark.createDataFrame([(0.3, 0.3, 0.3 + math.cos(a), 0.3 + math.sin(a)) for a in turn], "ex1 double, ey1 double, ex2 double, ey2 double")
    grid = Grid(segs, edges, cell=0.5, pairs=20_000, levels=3)
    s = grid.place(segs, ["x1", "y1", "x2", "y2"], ["seg"])
    e = grid.place(edges, EDGE, None)
    at = [*PLACE, "_salt"]
    pairs = s.groupBy(*at).agg(F.count("*").alias("s")).join(e.groupBy(*at).agg(F.count("*").alias("e")), at)
    assert grid.salted is not None and max(r.s * r.e for r in pairs.collect()) < 40_000
    hub = s.where("x1 = 0.3").join(e, at).where("_lv = 3").selectExpr("seg", "ex2", "ey2").distinct().count()
    assert hub >= 300 * 300  # every segment meets every edge at the shared point


def test_cover_meets_only_the_edges_of_border_cells(spark, frames, plain):
    """Points against whole rings by a ray, and the number of (point, edge) pairs the cover needs."""
    _, polys = frames
    rng = random.Random(6)
    points = [(i, rng.uniform(-1, 5), rng.uniform(-1, 4)) for i in range(800)]
    df = spark.createDataFrame(points, "i long, x double, y double")
    edges = _edges(polys)
    grid = Grid(_segments(frames[0]), edges, cell=0.1, pairs=400)
    met = grid.looked_up(df, "x", "y", ["i"]).join(grid.cover(edges, ["name"]), [*PLACE, "_salt"])
    change = Grid.changes(F.col("x"), F.col("y"), F.col("_cx"), F.col("_cy"))
    got = {(r.i, r.name) for r in met.groupBy("i", "name").agg(F.sum(change).alias("n")).where("n % 2 = 1").collect()}
    want = set()
    for i, x, y in points:
        for name, rings in plain[1]:
            hits = 0
            for ring in rings:
                for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                    hits += (ay > y) != (by > y) and ax + (y - ay) * (bx - ax) / (by - ay) > x
            if hits % 2:
                want.add((i, name))
    assert got == want and len(want) > 100
    by_edges = met.where("ex1 IS NOT NULL").count()
    bands = edges.withColumn("b", F.explode(F.expr("sequence(floor(least(ey1, ey2) / 0.1), floor(greatest(ey1, ey2) / 0.1))")))
    assert by_edges * 4 < df.selectExpr("floor(y / 0.1) AS b").join(bands, "b").count()


def test_wide_polygons_are_covered_by_blocks(spark):
    """The cover grows with the boundary: a square of 1000 x 1000 cells has far fewer rows than cells."""
    square = spark.createDataFrame([("s", [ln((0.05, 0.05), (100.05, 0.05), (100.05, 100.05), (0.05, 100.05))])], f"name string, rings array<array<{PT}>>")
    line = spark.createDataFrame([(1, ln((-5, 50.03), (105, 50.07)))], f"way_id long, pts array<{PT}>")
    edges = _edges(square)
    grid = Grid(_segments(line), edges, cell=0.1)
    assert grid.cover(edges, ["name"]).count() < 100_000
    got = clip.clip_lines(line, square, cell=0.1).collect()
    assert len(got) == 1 and round(got[0].pts[0].x, 9) == 0.05 and round(got[0].pts[-1].x, 9) == 100.05


def _window_stitch(inside):
    """All intervals of a line in one window: the plain version."""
    w = Window.partitionBy("k").orderBy("seg", "ta")
    new = F.when((F.lag("seg").over(w) == F.col("seg") - 1) & (F.lag("tb").over(w) > 1 - 1e-9) & (F.col("ta") < 1e-9)
                 | (F.lag("seg").over(w) == F.col("seg")) & (F.abs(F.lag("tb").over(w) - F.col("ta")) < 1e-9), 0).otherwise(1)
    pieces = inside.withColumn("new", new).withColumn("piece", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return {(r.k, r.piece): (r.n, r.low, r.high) for r in pieces.groupBy("k", "piece").agg(
        F.count("*").alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high")).collect()}


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_ranges_stitch_like_one_window(spark, size):
    rng = random.Random(9)
    rows = []
    for key in ("a", "b", None):
        for seg in range(400):
            kind = rng.choice("fffffffghn")
            spans = {"f": [(0.0, 1.0)], "g": [(0.0, 0.4)], "h": [(0.0, 0.3), (0.3, 0.5), (0.7, 1.0)], "n": []}[kind]
            rows += [(key, seg, ta, tb, {"x": seg + ta, "y": 0.0}, {"x": seg + tb, "y": 0.0}, "at") for ta, tb in spans]
    df = spark.createDataFrame(rows, f"k string, seg int, ta double, tb double, a {PT}, b {PT}, _attrs string")
    want = _window_stitch(df.where("k IS NOT NULL"))
    got = stitch(df, ["k"], size=size).collect()
    by = {(r.k, r.piece): r for r in got if r.k}
    assert set(by) == set(want) and len(by) == sum(r.k is not None for r in got)
    for key, (n, low, high) in want.items():
        pts = by[key].pts
        assert len(pts) <= n + 1 and math.floor(pts[0].x) == low and math.ceil(pts[-1].x) - 1 == high
        assert all(p.x == int(p.x) for p in pts[1:-1]) and len(pts) >= high - low + 2
        assert all(a.x < b.x for a, b in zip(pts, pts[1:]))


def test_long_line_is_stitched_by_many_tasks(spark):
    """300,000 segments inside one polygon but for some gaps: dealt by ranges, one piece between two gaps."""
    inside = spark.range(300_000).where("id % 70001 <> 70000").selectExpr(
        "'l' AS k", "int(id) AS seg", "0.0D AS ta", "1.0D AS tb", "struct(double(id) AS x, 0.0D AS y) AS a",
        "struct(double(id + 1) AS x, 0.0D AS y) AS b", "1 AS _attrs")
    got = stitch(inside, ["k"]).selectExpr("piece", "size(pts) AS n", "pts[0].x AS x").collect()
    assert sorted((r.piece, r.n, r.x) for r in got) == [(i + 1, 70_001 if i < 4 else 19_997, i * 70_001.0) for i in range(5)]
    ranged = inside.repartition(4, "k", F.floor(F.col("seg") / 4096)).groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) == 4
