"""Clustered spatial tables, top-k over a staged count, glimpse, file order."""

import random
import re

import pytest
from pyspark.sql import functions as F

from blotter.operators.topk import top_k_with_ties
from blotter.plans.basemap import main_roads
from blotter.sources.geo import BOX, in_box, read_clustered, with_box, write_clustered, z_order
from blotter.sources.profile import glimpse
from tables import table
from test_clip import PT, ln

HERE = (10.0, 10.0, 20.0, 20.0)


@pytest.fixture(scope="module")
def roads(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        x, y = rng.uniform(-60, 60), rng.uniform(-60, 60)
        rows.append((i, "primary", ln((x, y), (x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)))))
    rows += [(5000, "primary", None), (5001, "primary", []), (5002, "primary", ln((11, 11),)), (None, "primary", ln((9, 9), (13, 13)))]
    return spark.createDataFrame(rows, f"way_id long, highway string, pts array<{PT}>")


def scanned(df):
    """Rows that the Parquet scan gave."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "FileSourceScan" in node.getClass().getName():
            found += node.metrics().apply("numOutputRows").value()
        if "AdaptiveSparkPlanExec" in node.getClass().getName():
            todo.append(node.executedPlan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_clustered_table_is_pruned_by_the_box(spark, roads, tmp_path):
    path = write_clustered(roads, str(tmp_path / "roads"), files=32)
    everything = read_clustered(spark, path)
    want = sorted(r.way_id or -1 for r in main_roads(roads, box=HERE).collect())
    got = main_roads(everything, box=HERE)
    plan = got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan)[1]
    assert all(any(f"{kind}({c}," in pushed for kind in ("LessThanOrEqual", "GreaterThanOrEqual")) for c in BOX)
    assert sorted(r.way_id or -1 for r in got.collect()) == want and len(want) > 3
    rows = got.select("way_id")
    rows.collect()
    assert scanned(rows) < 1000 < roads.count()  # the other files' row groups are not read
    assert sorted(r.way_id or -1 for r in read_clustered(spark, path, HERE).collect()) == sorted(
        r.way_id or -1 for r in with_box(roads).where(in_box(HERE)).collect())


def test_z_order_interleaves_bits(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(1024)), float(rng.randrange(1024))) for _ in range(200)] + [(-5.0, 2000.0), (None, 1.0), (0.0, 1023.0)]
    got = spark.createDataFrame(rows, "x double, y double").select("x", "y", z_order(F.col("x"), F.col("y"), (0, 0, 1023, 1023), bits=10).alias("z"))
    for r in got.collect():
        if r.x is None:
            assert r.z is None
            continue
        x, y = (int(min(max(v, 0), 1023)) for v in (r.x, r.y))
        assert r.z == sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(10))


def test_polygons_of_several_rings(spark, tmp_path):
    areas = spark.createDataFrame([("a", [ln((0, 0), (4, 0), (4, 4)), ln((1, 1), (2, 9))]), ("b", [])], f"name string, rings array<array<{PT}>>")
    got = {r.name: tuple(r[c] for c in BOX) for r in read_clustered(spark, write_clustered(areas, str(tmp_path / "areas"))).collect()}
    assert got == {"a": (0.0, 0.0, 4.0, 9.0), "b": (None,) * 4}


def test_top_k_counts_once(spark):
    counts = table(spark, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    top = top_k_with_ties(counts, "n", 10, staged=True)
    rows = top.collect()
    all_n = sorted((r.n for r in counts.collect()), reverse=True)
    assert sorted((r.n for r in rows), reverse=True) == [n for n in all_n if n >= all_n[9]]
    plan = top._jdf.queryExecution().toString()
    assert "l_partkey" in plan and "lineitem" not in plan and "hashpartitioning" not in plan  # the counts are read, not made again


def test_glimpse_of_odd_values(spark):
    df = spark.createDataFrame([(2, None, "b"), (1, 1.5, "a"), (3, 2.0, "`")], "k int, `x y` double, s string")
    got = {r.column_name: (r.position, r.data_type, r.rows, r.nulls, r.first_values) for r in glimpse(df, "k", 2).collect()}
    assert got == {"k": (1, "int", 3, 0, "1, 2"), "x y": (2, "double", 3, 1, "1.5, NA"), "s": (3, "string", 3, 0, "a, b")}
    assert {r.first_values for r in glimpse(df.limit(0), "k").collect()} == {""}
