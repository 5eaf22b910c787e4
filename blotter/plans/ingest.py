"""Ingest: several CSV inputs to Parquet with reject counts, then cleaned-name reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import clean_names
from ..sources.csv import CsvSource, ingest_csv, ingest_summary, read_ingested


def ingest_tables(spark: SparkSession, sources: Mapping[str, CsvSource], dest_root: str) -> DataFrame:
    """Write every source to ``<dest_root>/<name>`` (one parse, one write job each) and return
    ``table_name, rows, rejected``."""
    dests = {name: ingest_csv(spark, src, f"{dest_root.rstrip('/')}/{name}") for name, src in sources.items()}
    return ingest_summary(spark, dests)


def load_table(spark: SparkSession, dest_root: str, name: str, clean: bool = True) -> DataFrame:
    """Good rows of an ingested table, with cleaned column names."""
    df = read_ingested(spark, f"{dest_root.rstrip('/')}/{name}")
    return clean_names(df) if clean else df
