"""Line-in-polygon clip: hand-made cases and a brute-force comparison on driver-derived data."""

import pytest

from blotter.operators.clip import clip_lines, line_intersects_box
from blotter.plans.basemap import base_map, main_roads, named_areas

PT = "struct<x:double,y:double>"


def sq(x0, y0, x1, y1):
    x0, y0, x1, y1 = map(float, (x0, y0, x1, y1))
    return [{"x": x0, "y": y0}, {"x": x1, "y": y0}, {"x": x1, "y": y1}, {"x": x0, "y": y1}, {"x": x0, "y": y0}]


def ln(*p):
    return [{"x": float(a), "y": float(b)} for a, b in p]


def _pieces(df):
    return sorted((r.way_id, r.name, r.piece, tuple((round(p.x, 9) + 0.0, round(p.y, 9) + 0.0) for p in r.pts))
                  for r in df.collect())


@pytest.fixture(scope="module")
def polys(spark):
    return spark.createDataFrame(
        [("unit", [sq(0, 0, 1, 1)]), ("holed", [sq(10, 0, 11, 1), sq(10.4, 0.4, 10.6, 0.6)]), ("right", [sq(1, 0, 2, 1)])],
        f"name string, rings array<array<{PT}>>")


CASES = [
    (1, ln((-1, 0.5), (2.5, 0.5)), [("right", ((1, 0.5), (2, 0.5))), ("unit", ((0, 0.5), (1, 0.5)))]),
    (2, ln((9, 0.5), (12, 0.5)), [("holed", ((10, 0.5), (10.4, 0.5))), ("holed", ((10.6, 0.5), (11, 0.5)))]),
    (3, ln((0.2, 0.2), (0.3, 0.7), (0.8, 0.8)), [("unit", ((0.2, 0.2), (0.3, 0.7), (0.8, 0.8)))]),
    (4, ln((5, 5), (6, 6)), []),
    (5, ln((-1, 0), (0.5, 0)), [("unit", ((0, 0), (0.5, 0)))]),
    (6, ln((-1, 1), (0.5, 1)), []),
    (7, ln((-1, -1), (3, 3)), [("unit", ((0, 0), (1, 1)))]),
]


@pytest.mark.parametrize("case", CASES, ids=[str(c[0]) for c in CASES])
def test_fixture_cases(spark, polys, case):
    wid, pts, expected = case
    lines = spark.createDataFrame([(wid, "primary", pts)], f"way_id long, highway string, pts array<{PT}>")
    out = clip_lines(lines, polys, ["way_id"], ["name"], cell=0.25)
    got = [(name, pts) for _, name, _, pts in _pieces(out)]
    want = sorted((n, tuple((float(x), float(y)) for x, y in p)) for n, p in expected)
    assert sorted(got) == want


def test_line_intersects_box(spark):
    rows = [(1, ln((0, 0), (1, 1))), (2, ln((-5, 0.5), (5, 0.5))), (3, ln((3, 3), (4, 4))), (4, ln((0.5, 0.5),)),
            (5, ln((-1, 2.5), (2.5, -1)))]
    df = spark.createDataFrame(rows, f"way_id long, pts array<{PT}>")
    got = {r.way_id: r.hit for r in df.select("way_id", line_intersects_box("pts", (0, 0, 2, 2)).alias("hit")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}
    # box corner (2, 2) region: a line passing just outside the corner
    df2 = spark.createDataFrame([(6, ln((1.5, 3), (3, 1.5)))], f"way_id long, pts array<{PT}>")
    assert df2.select(line_intersects_box("pts", (0, 0, 2, 2))).first()[0] is False


# ---------------------------------------------------------------------------------------------
# brute force: every segment against every edge, midpoint ray cast against every edge
# ---------------------------------------------------------------------------------------------
def _brute_clip(lines, polygons):
    out = []
    for wid, pts in lines:
        for name, rings in polygons:
            edges = [(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))]
            edges = [e for e in edges if e[0] != e[1]]
            kept = []
            for s in range(len(pts) - 1):
                (x1, y1), (x2, y2) = pts[s], pts[s + 1]
                rx, ry = x2 - x1, y2 - y1
                ts = {0.0, 1.0}
                for (ex1, ey1), (ex2, ey2) in edges:
                    sx, sy = ex2 - ex1, ey2 - ey1
                    d = rx * sy - ry * sx
                    if d == 0:
                        continue
                    qx, qy = ex1 - x1, ey1 - y1
                    t, u = (qx * sy - qy * sx) / d, (qx * ry - qy * rx) / d
                    if 1e-12 < t < 1 - 1e-12 and -1e-12 <= u <= 1 + 1e-12:
                        ts.add(round(t, 12))
                ts = sorted(ts)
                for ta, tb in zip(ts, ts[1:]):
                    if tb - ta <= 1e-11:
                        continue
                    tm = (ta + tb) / 2
                    mx, my = x1 + tm * rx, y1 + tm * ry
                    hits = 0
                    for (ex1, ey1), (ex2, ey2) in edges:
                        if (ey1 > my) != (ey2 > my):
                            xi = ex1 + (my - ey1) * (ex2 - ex1) / (ey2 - ey1)
                            if max(ex1, ex2) > mx and xi > mx:
                                hits += 1
                    if hits % 2 == 1:
                        kept.append((s, ta, tb, (x1 + ta * rx, y1 + ta * ry), (x1 + tb * rx, y1 + tb * ry)))
            pieces, cur, prev = [], None, None
            for s, ta, tb, a, b in kept:
                cont = prev is not None and ((prev[0] == s and abs(prev[2] - ta) < 1e-9)
                                             or (prev[0] == s - 1 and prev[2] > 1 - 1e-9 and ta < 1e-9))
                if cont:
                    cur.append(b)
                else:
                    cur = [a, b]
                    pieces.append(cur)
                prev = (s, ta, tb)
            for i, p in enumerate(pieces, start=1):
                out.append((wid, name, i, tuple((round(x, 9) + 0.0, round(y, 9) + 0.0) for x, y in p)))
    return sorted(out)


def test_base_map_matches_brute_force(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    areas = E._nation_polygons(E._t(spark, sf, "nation"), holes=True)
    roads = E._supplier_roads(E._t(spark, sf, "supplier"), bends=True)
    got = base_map(areas, roads, "name", E.KEPT_NATIONS, E.NATION_ALIASES, E.ROAD_TAGS[:5], E.GRID_BOX, cell=0.25)
    got_rows = sorted((r.way_id, r.borough_name, r.piece, tuple((round(p.x, 9) + 0.0, round(p.y, 9) + 0.0) for p in r.pts))
                      for r in got.collect())

    kept_areas = named_areas(areas, "name", E.KEPT_NATIONS, E.NATION_ALIASES).collect()
    kept_roads = main_roads(roads, E.ROAD_TAGS[:5], E.GRID_BOX).collect()
    polys = [(a.borough_name, [[(p.x, p.y) for p in ring] for ring in a.rings]) for a in kept_areas]
    lines = [(r.way_id, [(p.x, p.y) for p in r.pts]) for r in kept_roads]
    want = _brute_clip(lines, polys)
    assert len(want) > 0
    assert got_rows == want


def test_clip_lengths_bounded(spark):
    import math

    import __spark_entry__ as E

    sf = "/root/testdata/sf0.001"
    areas = E._nation_polygons(E._t(spark, sf, "nation"), holes=True)
    roads = E._supplier_roads(E._t(spark, sf, "supplier"), bends=True)
    out = clip_lines(roads, areas, cell=0.3)

    def length(pts):
        return sum(math.dist((a.x, a.y), (b.x, b.y)) for a, b in zip(pts, pts[1:]))

    total = {r.way_id: length(r.pts) for r in roads.collect()}
    clipped = {}
    for r in out.collect():
        clipped[r.way_id] = clipped.get(r.way_id, 0.0) + length(r.pts)
    assert clipped and all(clipped[w] <= total[w] + 1e-9 for w in clipped)


def test_tiling_preserves_length(spark):
    """Polygons that tile the plane split each line without losing or doubling any length."""
    import math
    import random

    rnd = random.Random(7)
    tiles = [(f"t{i}{j}", [sq(i, j, i + 1, j + 1)]) for i in range(5) for j in range(5)]
    polys = spark.createDataFrame(tiles, f"name string, rings array<array<{PT}>>")
    lines = []
    for wid in range(40):
        pts = [(rnd.uniform(0.05, 4.95), rnd.uniform(0.05, 4.95)) for _ in range(rnd.randint(2, 5))]
        lines.append((wid, "primary", ln(*pts)))
    lines_df = spark.createDataFrame(lines, f"way_id long, highway string, pts array<{PT}>")
    out = clip_lines(lines_df, polys, cell=0.37)

    def length(pts):
        return sum(math.dist((a.x, a.y), (b.x, b.y)) for a, b in zip(pts, pts[1:]))

    total = {}
    for r in out.collect():
        total[r.way_id] = total.get(r.way_id, 0.0) + length(r.pts)
    for wid, _, pts in lines:
        want = sum(math.dist((a["x"], a["y"]), (b["x"], b["y"])) for a, b in zip(pts, pts[1:]))
        assert abs(total[wid] - want) < 1e-9


def _square(x, y):
    return [(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0), (x, y)]


def test_two_part_borough_and_two_part_road_give_no_copies(spark):
    """Through the default keys of the base map: parts of a name are one district."""
    from blotter.plans.basemap import base_map

    areas = spark.createDataFrame([("Kings", 0, [_square(0.0, 0.0)]), ("Kings", 1, [_square(2.0, 0.0)])],
                                  f"name string, part int, rings array<array<{PT}>>")
    roads = spark.createDataFrame(
        [(1, 0, "primary", ln((-1.0, 0.5), (0.5, 0.5))), (1, 1, "primary", ln((0.7, 0.25), (5.0, 0.25))),
         (2, 0, "trunk", ln((0.25, 0.75), (0.5, 0.75)))],
        f"way_id long, part int, highway string, pts array<{PT}>")
    out = base_map(areas, roads, keep=("Kings",), aliases={"Kings": "Brooklyn"}, box=(-9, -9, 9, 9), cell=0.25)
    got = sorted((r.way_id, r.part, r.piece, [(round(p.x, 9), round(p.y, 9)) for p in r.pts]) for r in out.collect())
    assert got == [
        (1, 0, 1, [(0.0, 0.5), (0.5, 0.5)]),
        (1, 1, 1, [(0.7, 0.25), (1.0, 0.25)]),
        (1, 1, 2, [(2.0, 0.25), (3.0, 0.25)]),
        (2, 0, 1, [(0.25, 0.75), (0.5, 0.75)]),
    ]
    assert {r.borough_name for r in out.collect()} == {"Brooklyn"}


def test_null_keys_and_missing_polygons(spark):
    areas = spark.createDataFrame([(None, [_square(0.0, 0.0)])], f"name string, rings array<array<{PT}>>")
    roads = spark.createDataFrame([(None, "primary", ln((-1.0, 0.5), (0.5, 0.5)))], f"way_id long, highway string, pts array<{PT}>")
    got = clip_lines(roads, areas, cell=0.25).collect()
    assert [(r.name, r.way_id, r.piece) for r in got] == [(None, None, 1)]
    assert clip_lines(roads, areas.limit(0), cell=0.25).count() == 0
