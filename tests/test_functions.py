from pyspark.sql import functions as F

from blotter.functions.dates import as_date, month_of
from blotter.functions.labels import (
    flip_angle,
    flip_hjust,
    fraction_percent_label,
    integer_label,
    month_label,
    percent_label,
    short_scale_label,
)
from blotter.functions.names import clean_names, clean_names_list
from blotter.functions.recode import colour_map, recode
from blotter.functions.scales import censor, in_view


def test_clean_names_fixture():
    raw = ["New Georeferenced Column", "PD_DESC", "% Share", "a", "A"]
    assert clean_names_list(raw) == ["new_georeferenced_column", "pd_desc", "percent_share", "a", "a_2"]


def test_clean_names_more():
    assert clean_names_list(["newGeoreferencedColumn", "1st", "#", "Order%Priority", "x", "x", "x_2"]) == [
        "new_georeferenced_column", "x1st", "number", "order_percent_priority", "x", "x_2", "x_2_2"]


def test_clean_names_df(spark):
    df = spark.createDataFrame([(1, 2)], "`Total Price ($)` int, `Order Date` int")
    assert clean_names(df).columns == ["total_price", "order_date"]


def test_percent_label(spark):
    df = spark.createDataFrame([(12.0,), (2.25,), (33.3333,)], "p double")
    assert [r.l for r in df.select(percent_label("p").alias("l")).collect()] == ["12%", "2.2%", "33.3%"]


def test_flip(spark):
    df = spark.createDataFrame([(-100.0,), (-90.0,), (45.0,)], "a double")
    got = [(r.x, r.h) for r in df.select(flip_angle("a").alias("x"), flip_hjust("a").alias("h")).collect()]
    assert got == [(80.0, 1), (-90.0, 0), (45.0, 0)]


def test_short_scale(spark):
    df = spark.createDataFrame([(950.0,), (22500.0,), (1500000.0,), (2.5e9,), (-1234.0,)], "x double")
    got = [r.l for r in df.select(short_scale_label("x", 0.1).alias("l")).collect()]
    assert got == ["950.0", "22.5K", "1.5M", "2.5B", "-1.2K"]


def test_integer_and_fraction_labels(spark):
    df = spark.createDataFrame([(87.9, 0.25), (3e10, 1.0)], "x double, f double")
    got = df.select(integer_label("x").alias("i"), fraction_percent_label("f").alias("p")).collect()
    assert [(r.i, r.p) for r in got] == [("87", "25%"), (None, "100%")]


def test_month_label_and_dates(spark):
    df = spark.createDataFrame([("01/25/2024",), ("12/01/2023",), ("2024-01-02",), (None,)], "d string")
    out = df.select(month_of(as_date(df, "d")).alias("m")).select("m", month_label("m").alias("l")).collect()
    assert [(r.m, r.l) for r in out] == [(1, "Jan"), (12, "Dec"), (None, None), (None, None)]


def test_recode_passthrough_and_null(spark):
    df = spark.createDataFrame([("M",), ("F",), ("U",), (None,)], "s string")
    out = df.select(recode("s", {"M": "Male", "F": "Female"}).alias("r"), colour_map("s", {"M": "#1"}).alias("c"))
    assert [(r.r, r.c) for r in out.collect()] == [("Male", "#1"), ("Female", None), ("U", None), (None, None)]


def test_censor(spark):
    df = spark.createDataFrame([(39.0,), (40.0,), (110.0,), (111.0,)], "y double")
    assert [r.c for r in df.select(censor("y", (40, 110)).alias("c")).collect()] == [None, 40.0, 110.0, None]
    assert [r.c for r in df.select(censor("y", None).alias("c")).collect()] == [39.0, 40.0, 110.0, 111.0]


def test_in_view(spark):
    df = spark.createDataFrame([(0.0, 0.0), (-74.0, 40.7), (None, 40.7)], "lon double, lat double")
    assert [r.v for r in df.select(in_view("lon", "lat").alias("v")).collect()] == [False, True, False]


def test_chained_columns_see_new_values(spark):
    # P3: replace a by a*2, then b = a + 1 must see the new a
    df = spark.createDataFrame([(10,)], "a int")
    out = df.withColumn("a", F.col("a") * 2).withColumn("b", F.col("a") + 1).first()
    assert out.b == 21
