import tempfile

from blotter.plans.incidents import category_counts
from blotter.streaming.incidents import (
    category_counts_stream,
    monthly_counts_stream,
    read_parquet_stream,
    start_snapshots,
)
from tables import SF, table


def test_stream_category_counts_equal_batch(spark):
    docs = table(spark, "documents")
    stream = read_parquet_stream(spark, SF, docs.schema, glob="documents.parquet")
    assert stream.isStreaming
    out = tempfile.mkdtemp(prefix="blotter-stream-")
    q = start_snapshots(category_counts_stream(stream, "text"), out + "/counts")
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out + "/counts").collect())
    want = sorted(tuple(r) for r in category_counts(docs, "text").collect())
    assert got == want


def test_stream_monthly_counts(spark):
    orders = table(spark, "orders")
    stream = read_parquet_stream(spark, SF, orders.schema, glob="orders.parquet")
    out = tempfile.mkdtemp(prefix="blotter-stream-")
    q = start_snapshots(monthly_counts_stream(stream, "o_orderdate", "total_orders"), out + "/m")
    q.awaitTermination(120)
    got = spark.read.parquet(out + "/m")
    assert got.count() == 12
    assert sum(r.total_orders for r in got.collect()) == orders.count()
