"""Shared parts of the vector searches: clean vectors, blocks of rows and of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block of candidates, and queries of one block.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024


def clean(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec): rows with a key and a vector of finite components, as doubles.

    Vectors of another length than the most common one take no part (nor can they be compared); of
    equally common lengths the larger counts.
    """
    vec = F.col(vector).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col(key).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & (F.size("vec") > 0) & F.coalesce(finite, F.lit(False)))
    lengths = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("vec") == (lengths["dim"] if lengths else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a (rows, dim) array of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(n, -1) if n else flat.reshape(0, 0), dtype=np.float64)


def list_column(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, dim = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim or 1)[:n + 1], pa.int32()), pa.array(values.ravel()))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def top_k(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query's finds from all blocks.

    Spark keeps k rows of a query in each task before the exchange.
    """
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
