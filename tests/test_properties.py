"""Randomised checks against plain-Python references (few examples: each one runs Spark jobs)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from blotter.operators.running import running_total
from blotter.operators.topk import top_k_with_ties
from pyspark.sql import functions as F

COUNTS = st.lists(st.integers(min_value=1, max_value=6), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(counts=COUNTS, k=st.integers(min_value=1, max_value=12))
def test_top_k_matches_reference(spark, counts, k):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "key int, n long")
    got = sorted(r.key for r in top_k_with_ties(df, "n", k).collect())
    kth = sorted(counts, reverse=True)[min(k, len(counts)) - 1]
    assert got == sorted(i for i, n in enumerate(counts) if n >= kth)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(min_value=0, max_value=100), min_size=1, max_size=30),
       parts=st.sampled_from([None, 3]))
def test_running_total_matches_reference(spark, values, parts):
    df = spark.createDataFrame([(f"k{i:03d}", float(v)) for i, v in enumerate(values)], "k string, v double")
    out = running_total(df, "v", [F.col("k").desc()], "cum", "before", partitions=parts)
    got = {r.k: (r.cum, r.before) for r in out.collect()}
    acc = 0.0
    for i in reversed(range(len(values))):
        key = f"k{i:03d}"
        assert got[key] == (acc + values[i], acc)
        acc += values[i]
