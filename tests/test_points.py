
from blotter.operators.layers import union_layers
from blotter.operators.points import crs_of, point_counts, points_from_wkt, rejected_wkt, to_crs, valid_points, with_crs
from blotter.plans.hotspots import top_locations, weapons_vs_shootings


def test_valid_points(spark):
    # P4/P5: only the last survives
    rows = [(None, 1.0), (0.0, -73.9), (40.7, 0.0), (float("nan"), -73.9), (40.7, -73.9)]
    df = spark.createDataFrame(rows, "latitude double, longitude double")
    assert [tuple(r) for r in valid_points(df).collect()] == [(40.7, -73.9)]


def test_wkt_points(spark):
    # G2: two equal points; three rejected
    rows = [("POINT (-73.9 40.7)",), ("POINT(-73.9 40.7)",), ("POINT EMPTY",), (None,), ("LINESTRING (0 0, 1 1)",)]
    df = spark.createDataFrame(rows, "g string")
    pts = points_from_wkt(df, "g")
    assert [tuple(r) for r in point_counts(pts).collect()] == [(-73.9, 40.7, 2)]
    assert rejected_wkt(df, "g").count() == 3
    assert crs_of(pts, "lon") == 4326


def test_crs_tags(spark):
    df = with_crs(spark.createDataFrame([(1.0, 2.0)], "lon double, lat double"), ["lon", "lat"], 4326)
    assert crs_of(to_crs(df, ["lon", "lat"], 4269), "lon") == 4269
    other = with_crs(df, ["lon", "lat"], 3857)
    try:
        union_layers({"a": df, "b": other})
        raise AssertionError("mixed CRS accepted")
    except ValueError:
        pass


def test_top_locations_viewport_and_scale(spark):
    # P12: a point at (0,0)-like far location with the largest n is out of view but sets the max size
    rows = [(40.7, -73.9, "Violent Crime")] * 3 + [(10.0, 10.0, "Violent Crime")] * 5 + [(40.6, -74.0, "Other")] * 9
    df = spark.createDataFrame(rows, "latitude double, longitude double, category string")
    out = {(r.lon, r.lat): r for r in top_locations(df, k=100).collect()}
    assert set(out) == {(-73.9, 40.7), (10.0, 10.0)}
    far = out[(10.0, 10.0)]
    assert far.in_view is False and far.size == 8.0 and far.colour == "#ff0000"
    assert out[(-73.9, 40.7)].in_view is True and out[(-73.9, 40.7)].size == 2.0


def test_weapons_vs_shootings(spark):
    arrests = spark.createDataFrame(
        [("Weapons/Explosives", "POINT (-73.9 40.7)")] * 2 + [("Violent Crime", "POINT (-73.8 40.6)")],
        "category string, new_georeferenced_column string")
    shootings = spark.createDataFrame([("POINT (-73.95 40.65)",)] * 4 + [("POINT EMPTY",)],
                                      "new_georeferenced_column string")
    out = {r.series: r for r in weapons_vs_shootings(arrests, shootings).collect()}
    assert out["Weapon Arrests"].n == 2 and out["Weapon Arrests"].colour == "blue" and out["Weapon Arrests"].size == 2.0
    assert out["Shooting Incidents"].n == 4 and out["Shooting Incidents"].colour == "red" and out["Shooting Incidents"].size == 8.0


def test_zero_point_kept_in_layers_but_out_of_view(spark):
    # P12 / D5: in the two-layer map (0, 0) is kept by default; it is hidden by the viewport
    # but still trains the size scale
    arrests = spark.createDataFrame(
        [("Weapons/Explosives", "POINT (0 0)")] * 6 + [("Weapons/Explosives", "POINT (-73.9 40.7)")] * 2,
        "category string, new_georeferenced_column string")
    shootings = spark.createDataFrame([("POINT (-73.95 40.65)",)], "new_georeferenced_column string")
    rows = {(r.series, r.lon, r.lat): r for r in weapons_vs_shootings(arrests, shootings).collect()}
    zero = rows[("Weapon Arrests", 0.0, 0.0)]
    assert zero.in_view is False and zero.size == 8.0
    assert rows[("Shooting Incidents", -73.95, 40.65)].size == 2.0
    dropped = weapons_vs_shootings(arrests, shootings, drop_zero=True).collect()
    assert all((r.lon, r.lat) != (0.0, 0.0) for r in dropped)
