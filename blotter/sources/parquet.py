"""Parquet sink and source, and session tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import clean_names


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (),
                  max_records_per_file: int | None = None) -> str:
    """Write a directory of Parquet part files (one per task). Returns ``path``."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.parquet(path)
    return path


def read_parquet(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """Lazy Parquet scan (only the columns and row groups a query needs are read),
    with header cleaning by default."""
    df = spark.read.parquet(path)
    return clean_names(df) if clean else df


def register_table(df: DataFrame, name: str) -> DataFrame:
    """Expose ``df`` to SQL under ``name`` (a view: nothing is computed or stored)."""
    df.createOrReplaceTempView(name)
    return df
