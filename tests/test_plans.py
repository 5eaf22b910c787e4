"""Plan-shape checks: the physical plans the operators are designed to produce."""

import re
import tempfile

from pyspark.sql import functions as F

from blotter.functions.categorise import categorise
from blotter.operators.clip import clip_lines
from blotter.operators.counts import count_by
from blotter.operators.shares import share_of_total
from blotter.operators.topk import top_k_with_ties
from blotter.plans.hotspots import top_locations
from blotter.plans.incidents import category_counts
from tables import table


def plan_of(df):
    df.collect()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    return plan_of(df).split("== Initial Plan ==")[0]


def test_hotspots_push_filters_and_prune_columns(spark):
    import __spark_entry__ as E

    d = tempfile.mkdtemp(prefix="blotter-plan-")
    orders = table(spark, "orders")
    E._order_points(orders).withColumnRenamed("o_orderstatus", "category").withColumn("unused", F.lit(1)) \
        .write.parquet(d + "/p")
    plan = plan_of(top_locations(spark.read.parquet(d + "/p"), exclude="P"))
    pushed = " ".join(re.findall(r"PushedFilters: \[[^\]]*\]", plan))
    assert "IsNotNull(longitude)" in pushed and "IsNotNull(latitude)" in pushed
    schemas = set(re.findall(r"ReadSchema: struct<[^>]*>", plan))
    assert schemas == {"ReadSchema: struct<longitude:double,latitude:double,category:string>"}


def test_top_k_has_no_single_partition_window(spark):
    plan = plan_of(top_k_with_ties(count_by(table(spark, "lineitem"), "l_partkey"), "n", 100))
    assert "TakeOrderedAndProject(limit=100" in plan
    assert "Window" not in plan
    assert "ReusedExchange" in plan  # the count shuffle is computed once for filter and threshold


def test_share_of_total_uses_scalar_subquery(spark):
    plan = plan_of(share_of_total(count_by(table(spark, "customer"), "c_mktsegment")))
    assert "Subquery" in plan and "Window" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_inline_categorisation_shuffles_only_counts(spark):
    plan = plan_of(category_counts(table(spark, "documents"), "text"))
    exchanges = re.findall(r"Exchange (\w+)", plan)
    # one shuffle of partial counts by category; the text itself never moves
    assert exchanges and all(e in ("hashpartitioning", "SinglePartition") for e in exchanges)
    assert "text" not in " ".join(re.findall(r"Exchange hashpartitioning\([^)]*\)", plan))


def test_long_line_is_spread_until_stitching(spark):
    """Crossings, inside tests and stitching of one long line run in many tasks."""
    n = 4000
    pts = [(i * 0.002, 0.25 + 0.5 * (i % 2)) for i in range(n + 1)]
    pt = "struct<x:double,y:double>"
    line = spark.createDataFrame([(1, "primary", pts)], f"way_id long, highway string, pts array<{pt}>")
    ring = [(0.0, 0.0), (9.0, 0.0), (9.0, 0.5), (0.0, 0.5), (0.0, 0.0)]
    area = spark.createDataFrame([("a", [ring])], f"name string, rings array<array<{pt}>>")
    out = clip_lines(line, area, cell=0.25)
    final = final_plan(out)
    hashed = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", final)
    assert any("seg#" in h for h in hashed)
    alone = [h for h in hashed if "_line#" in h and "seg#" not in h and "_range#" not in h and "piece#" not in h]
    assert len(alone) <= 1  # one row for each range of segments; the intervals stay with their range
    assert out.count() == n // 2 + 1


def test_category_filter_does_not_rerun_rules(spark):
    from blotter.plans.incidents import with_category

    docs = table(spark, "documents", "/root/testdata/sf0.01")  # has matches, so AQE keeps the scan
    q = with_category(docs, "text").where(F.col("category") != "Other") \
        .where(F.col("lang").isNotNull()).groupBy("category", "lang").count()
    plan = final_plan(q)
    assert "Python" not in plan and plan.count("translate(") == 1
    # the filter on another column still reaches the scan
    assert "DataFilters: [isnotnull(lang" in plan
