"""Staged tables: their shuffle files go with the write, they themselves with their last reader."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from blotter.llm.components import components
from blotter.llm.store import BATCH, CLEANUP, drop, stage


def test_a_staged_table_is_read_back_and_dropped(spark):
    before = spark.conf.get(CLEANUP, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept, gone = stage(df, "store-kept"), stage(df, "store-gone")
    assert spark.conf.get(CLEANUP, None) == before
    folder = os.path.dirname(gone.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder)
    drop(gone.select("k").where("n > 1"))  # by whatever is read from it
    assert not os.path.exists(folder)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))


def test_a_stage_hands_texts_to_python_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    before = spark.conf.get(BATCH, None)
    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    got = [r.n for r in stage(texts.mapInArrow(sizes, "n long"), "store-batches").collect()]
    assert spark.conf.get(BATCH, None) == before
    assert sum(got) > 12_000_000 and max(got) < 6_000_000


def test_an_empty_table_is_dropped(spark):
    empty = stage(spark.range(0), "store-empty")
    assert empty.count() == 0
    drop(empty)


def test_components_leave_one_table(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long")
    found = components(edges)
    assert {(r.id, r.root) for r in found.collect()} == {(i, 0) for i in range(1, 41)} | {(91, 90)}
    tables = os.path.dirname(os.path.dirname(found.inputFiles()[0].removeprefix("file://")))
    first = len(os.listdir(tables))
    components(edges)
    assert len(os.listdir(tables)) == first + 1
