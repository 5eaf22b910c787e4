import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.functions.names import clean_names
from blotter.plans.ingest import ingest_tables, load_table
from blotter.sources.csv import CsvSource, read_csv, read_csv_text, read_rejects
from blotter.sources.geo import read_lines, read_polygons, write_line_features, write_polygon_features
from blotter.sources.parquet import read_parquet, register_table, write_parquet
from blotter.sources.profile import profile
from tables import table

BAD_CSV = 'a,b,c\n1,"x, ""q""",007\n2,short\n3,x,y,z\n4,ok,008\n'


def _file(text):
    d = tempfile.mkdtemp(prefix="blotter-test-")
    p = os.path.join(d, "in.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_text_csv_drops_malformed_and_keeps_zeros(spark):
    df = read_csv_text(spark, _file(BAD_CSV))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [("1", 'x, "q"', "007"), ("4", "ok", "008")]


def test_ingest_counts_rejects(spark):
    src = _file(BAD_CSV)
    dest = tempfile.mkdtemp(prefix="blotter-ingest-")
    summary = ingest_tables(spark, {"licenses": CsvSource(src, text=True)}, dest)
    assert [tuple(r) for r in summary.collect()] == [("licenses", 2, 2)]
    assert sorted(r[0] for r in read_rejects(spark, f"{dest}/licenses").collect()) == ["2,short", "3,x,y,z"]
    assert load_table(spark, dest, "licenses").count() == 2


def test_typed_csv_dates_and_type_rejects(spark):
    src = _file("Arrest Date,PD_DESC,Latitude\n01/25/2024,ASSAULT 3,40.7\n13/45/2024,X,1\n02/01/2024,THEFT,abc\n")
    schema = T.StructType([T.StructField("Arrest Date", T.DateType()), T.StructField("PD_DESC", T.StringType()),
                           T.StructField("Latitude", T.DoubleType())])
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_csv(spark, src, schema).collect()
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        read_csv(spark, src, schema).select("PD_DESC").collect()  # whatever is projected
    df = clean_names(read_csv(spark, src, schema, mode="PERMISSIVE"))
    assert df.columns == ["arrest_date", "pd_desc", "latitude"]
    dest = tempfile.mkdtemp(prefix="blotter-ingest-")
    summary = ingest_tables(spark, {"arrests": CsvSource(src, schema)}, dest).first()
    assert (summary.rows, summary.rejected) == (1, 2)
    good = load_table(spark, dest, "arrests").first()
    assert str(good.arrest_date) == "2024-01-25" and good.pd_desc == "ASSAULT 3"


def test_parquet_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="blotter-pq-")
    df = spark.createDataFrame([(1, "x")], "`Total Price ($)` int, `PD_DESC` string")
    write_parquet(df, f"{d}/t")
    back = read_parquet(spark, f"{d}/t")
    assert back.columns == ["total_price", "pd_desc"]
    register_table(back, "t_view")
    assert spark.sql("select count(*) from t_view").first()[0] == 1


def test_profile(spark):
    orders = table(spark, "orders")
    p = {r.column_name: r for r in profile(orders).collect()}
    assert set(p) == set(orders.columns)
    assert all(r.rows == orders.count() and r.non_null + r.nulls == r.rows for r in p.values())
    assert p["o_orderdate"].data_type == "timestamp_ntz"


def test_geo_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="blotter-geo-")
    pt = "struct<x:double,y:double>"
    polys = spark.createDataFrame([("Kings", [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]])],
                                  f"name string, rings array<array<{pt}>>")
    lines = spark.createDataFrame([(7, "primary", [{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 2.0}])],
                                  f"way_id long, highway string, pts array<{pt}>")
    write_polygon_features(polys, f"{d}/p")
    write_line_features(lines, f"{d}/l")
    p = read_polygons(spark, f"{d}/p").first()
    ln = read_lines(spark, f"{d}/l").first()
    assert p.name == "Kings" and len(p.rings[0]) == 3 and p.rings[0][1].x == 1.0
    assert ln.way_id == 7 and ln.highway == "primary" and ln.pts[1].y == 2.0
    # multi-geometries
    with open(f"{d}/multi.json", "w") as f:
        f.write('{"type":"Feature","properties":{"NAME":"Queens"},"geometry":{"type":"MultiPolygon",'
                '"coordinates":[[[[0,0],[1,0],[0,1],[0,0]]],[[[5,5],[6,5],[5,6],[5,5]]]]}}\n')
        f.write('{"type":"Feature","properties":{"osm_id":"9","highway":"trunk"},"geometry":{"type":"MultiLineString",'
                '"coordinates":[[[0,0],[1,1]],[[2,2],[3,3]]]}}\n')
    mp = read_polygons(spark, f"{d}/multi.json")
    assert sorted(r.part for r in mp.collect()) == [0, 1]
    assert read_lines(spark, f"{d}/multi.json").count() == 2


def test_malformed_rows_independent_of_projection(spark):
    from blotter.sources.csv import STATUS, read_csv_tagged

    src = _file(BAD_CSV)
    df = read_csv_text(spark, src)
    assert df.count() == 2 and df.select("b").count() == 2 and len(df.collect()) == 2
    tagged = read_csv_tagged(spark, src, text=True)
    assert tagged.where(F.col(STATUS) == "ok").count() == 2
    assert tagged.where(F.col(STATUS) == "rejected").select("a").count() == 2
