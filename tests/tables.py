"""The driver's tables for the tests."""

SF = "/root/testdata/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")
