"""Table profile: row count, per-column type, non-null and null counts, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def profile(df: DataFrame) -> DataFrame:
    """One row per column: ``column_name, position, data_type, rows, non_null, nulls``.

    All counts come from a single aggregate over the table (partial counts per task, one
    final row), then the row is turned into one entry per column.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count(F.col(_q(c))).alias(f"_nn{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(i + 1).alias("position"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"_nn{i}").alias("non_null"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return one.select(F.col("_rows").alias("rows"), F.explode(F.array(*entries)).alias("e")).select(
        F.col("e.column_name").alias("column_name"),
        F.col("e.position").alias("position"),
        F.col("e.data_type").alias("data_type"),
        F.col("rows"),
        F.col("e.non_null").alias("non_null"),
        (F.col("rows") - F.col("e.non_null")).alias("nulls"),
    )


def glimpse(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """``profile`` with the type's name and the first ``n`` values of each column, as text, rows taken by ``order``.

    The first values come from one top-n of the rows; NULL shows as ``NA``. An empty table has empty texts.
    """
    rest = [F.coalesce(F.col(_q(c)).cast("string"), F.lit("NA")).alias(f"_v{i}") for i, c in enumerate(df.columns)]
    first = df.select(F.col(_q(order)).alias("_order"), *rest).orderBy("_order", *[f"_v{i}" for i in range(len(rest))]).limit(n)
    firsts = first.agg(F.array_sort(F.collect_list(F.struct("_order", *[f"_v{i}" for i in range(len(rest))]))).alias("r"))  # n rows
    entries = [F.struct(F.lit(i + 1).alias("position"), F.concat_ws(", ", F.col(f"r._v{i}")).alias("first_values"))
               for i in range(len(rest))]
    values = firsts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return profile(df).join(values, "position").select(
        "column_name", "position", "data_type", "rows", "non_null", "nulls", "first_values")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows (a preview is a row cap by definition)."""
    return df.limit(n)
