import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from blotter.functions.scales import palette_by_order, size_scale
from blotter.operators.counts import count_by, distinct_values, monthly_counts
from blotter.operators.donut import donut_geometry
from blotter.operators.running import row_number_global, running_total
from blotter.operators.shares import reorder_levels, share_of_total, share_within, stack_fill
from blotter.operators.topk import top_k_with_ties
from blotter.plans.incidents import donut_segments, share_by_group, share_then_exclude
from tables import table


def test_share_within_fixture(spark):
    # W1: (A,M,3),(A,F,1),(B,M,2),(A,null,4) -> 37.5, 12.5, 100, 50
    df = spark.createDataFrame([("A", "M", 3), ("A", "F", 1), ("B", "M", 2), ("A", None, 4)], "g string, k string, n long")
    got = {(r.g, r.k): r.percent for r in share_within(df, "g").collect()}
    assert got == {("A", "M"): 37.5, ("A", "F"): 12.5, ("B", "M"): 100.0, ("A", None): 50.0}


def test_share_then_exclude_denominators(spark):
    # W2 + P8 + P9: BLACK 2, WHITE 1, UNKNOWN 1, null 4 -> 50, 25; UNKNOWN hidden but counted; null not
    rows = [("BLACK",)] * 2 + [("WHITE",)] + [("UNKNOWN",)] + [(None,)] * 4
    df = spark.createDataFrame(rows, "perp_race string")
    out = {r.perp_race: r for r in share_then_exclude(df).collect()}
    assert set(out) == {"BLACK", "WHITE"}
    assert out["BLACK"].percent == 50.0 and out["WHITE"].percent == 25.0
    # descending order: WHITE first (ypos 12.5), BLACK second (ypos 25 + 25 = 50); angle over the shown 75
    assert out["WHITE"].ypos == 12.5 and out["BLACK"].ypos == 50.0
    assert abs(out["BLACK"].angle - (90 - 360 * 50 / 75)) < 1e-9
    assert out["BLACK"].label == "50%" and out["WHITE"].colour == "#7209b7" and out["BLACK"].colour == "#f72585"


def test_age_order_and_segments(spark):
    # O1 order for ages, W3/W4 bounds
    ages = ["<18", "18-24", "25-44", "45-64", "65+"]
    rows = [(a,) for a, k in zip(ages, [1, 2, 3, 4, 5]) for _ in range(k)] + [(None,)]
    out = donut_segments(spark.createDataFrame(rows, "age_group string")).orderBy("ymin").collect()
    assert [r.age_group for r in out] == ["<18", "65+", "45-64", "25-44", "18-24"]
    for a, b in zip(out, out[1:]):
        assert abs(a.ymax - b.ymin) < 1e-9
    assert abs(out[-1].ymax - 100.0) < 1e-9 and out[0].ymin == 0.0


def test_running_total_fixture(spark):
    # W3/W4: 10, 30, 60 in order -> ymax 10, 40, 100; ymin 0, 10, 40
    df = spark.createDataFrame([("c", 10.0), ("b", 30.0), ("a", 60.0)], "k string, p double")
    out = running_total(df, "p", [F.col("k").desc()], "ymax", "ymin").orderBy(F.col("k").desc()).collect()
    assert [(r.ymax, r.ymin) for r in out] == [(10.0, 0.0), (40.0, 10.0), (100.0, 40.0)]


def test_running_total_matches_window(spark):
    df = table(spark, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    got = running_total(df, "n", [F.col("l_partkey").asc()], "cum", partitions=7)
    w = Window.orderBy("l_partkey").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("cum", F.sum("n").over(w))
    assert sorted(got.collect()) == sorted(ref.collect())
    ranks = row_number_global(df, [F.col("n").desc(), F.col("l_partkey").asc()], "rk").collect()
    assert sorted(r.rk for r in ranks) == list(range(1, len(ranks) + 1))


def test_stack_fill_and_reorder(spark):
    df = spark.createDataFrame([("A", "Male", 75.0), ("A", "Female", 25.0), ("B", "Male", 50.0), ("B", "Female", 50.0)],
                               "c string, s string, percent double")
    out = {(r.c, r.s): r for r in stack_fill(df, "c", "s").collect()}
    assert out[("A", "Male")].ymin == 0.0 and out[("A", "Male")].ymax == 0.75
    assert out[("A", "Female")].ymin == 0.75 and out[("A", "Female")].ymax == 1.0
    assert out[("A", "Female")].ymid == 0.875
    ordered = {r.c: r.ord for r in reorder_levels(df, "c", "percent").collect()}
    assert ordered == {"A": 1, "B": 2}  # mean(-percent) is -50 for both: ties by name


def test_share_by_group_sums(spark):
    df = table(spark, "orders").withColumnRenamed("o_orderstatus", "category").withColumnRenamed("o_orderpriority", "perp_sex")
    out = share_by_group(df, exclude=("P",), group_names={}, key_names={}).collect()
    for g in {r.category for r in out}:
        rows = [r for r in out if r.category == g]
        assert abs(sum(r.percent for r in rows) - 100.0) < 1e-9
        assert abs(max(r.ymax for r in rows) - 1.0) < 1e-9


def test_top_k_with_ties(spark):
    # O2: counts 5,4,4,3 with k=2 -> three rows 5,4,4
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 4), ("d", 3)], "k string, n long")
    assert sorted(r.n for r in top_k_with_ties(df, "n", 2).collect()) == [4, 4, 5]
    assert top_k_with_ties(df, "n", 10).count() == 4
    assert top_k_with_ties(df.where("n > 10"), "n", 2).count() == 0


def test_top_k_property(spark):
    counts = count_by(table(spark, "lineitem"), "l_partkey")
    top = top_k_with_ties(counts, "n", 100)
    kept = {r.l_partkey for r in top.collect()}
    assert len(kept) >= 100
    low = min(r.n for r in top.collect())
    assert counts.where(~F.col("l_partkey").isin(*kept)).where(F.col("n") >= low).count() == 0


def test_size_scale(spark):
    # n = 1, 26, 101 -> 2, 5, 8; all equal -> 2 + 6*sqrt(0.5)
    df = spark.createDataFrame([(1,), (26,), (101,)], "n long")
    assert sorted(round(r.size, 9) for r in size_scale(df).collect()) == [2.0, 5.0, 8.0]
    eq = spark.createDataFrame([(7,), (7,)], "n long")
    assert all(abs(r.size - (2 + 6 * 0.5 ** 0.5)) < 1e-9 for r in size_scale(eq).collect())


def test_monthly_counts_null_last(spark):
    # A2: Jan 2023, Jan 2024, null -> month 1 -> 2, null -> 1, last
    df = spark.createDataFrame([("01/05/2023",), ("01/07/2024",), (None,)], "d string")
    assert [(r.month, r.total) for r in monthly_counts(df, "d").collect()] == [(1, 2), (None, 1)]


def test_distinct_and_share_of_total(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,)], "v string")
    assert sorted(distinct_values(df, "v").collect(), key=str) == sorted([(None,), ("x",)], key=str)
    shares = {r.v: r.percent for r in share_of_total(count_by(df, "v")).collect()}
    assert abs(shares["x"] - 200 / 3) < 1e-9


def test_palette_by_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    got = {r.k: r.colour for r in palette_by_order(df, "k", ["#1", "#2"]).collect()}
    assert got == {"a": "#1", "b": "#2", "c": None}


def test_donut_angle_uses_rows_left(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("hidden", 4)], "k string, n long")
    out = {r.k: r for r in donut_geometry(df, "k", "n", "ypos", hidden=["hidden"]).collect()}
    assert sorted(out) == ["a", "b"] and out["b"].percent == 30.0 and (out["b"].ord, out["b"]["rank"]) == (1, 2)
    assert out["b"].ypos == 15.0 and abs(out["b"].angle - 0.0) < 1e-9
    assert abs(out["a"].angle - (-180.0)) < 1e-9 and out["a"].label_angle == 0.0 and out["a"].hjust == 1


def test_stack_null_level_at_bottom(spark):
    # W7: stacking starts from the last level; a NULL level comes last, so it sits at the bottom
    df = spark.createDataFrame([("A", "Female", 1), ("A", "Male", 2), ("A", None, 1)], "c string, s string, n long")
    out = {r.s: r for r in stack_fill(df, "c", "s", "n").collect()}
    assert out[None].ymin == 0.0 and out[None].ymax == 0.25
    assert out["Male"].ymin == 0.25 and out["Male"].ymax == 0.75
    assert out["Female"].ymax == 1.0 and out["Female"].ymid == 0.875


def test_running_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(f"k{i:04d}", rng.randint(1, 10**6)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, n long")
    seen = set()
    for parts in (1, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = donut_geometry(df.repartition(parts), "k").select("k", "ymin", "ymax", "label_pos", "angle").collect()
        seen.add(tuple(sorted(map(tuple, out))))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1
