"""Bounded samples of tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Expected keys below the first cut for each one wanted, and how much the cut rises while too few are found.
SPARE, RISE = 2, 8


def sample_keys(keys: DataFrame, count: int) -> DataFrame:
    """(key, hash): the ``count`` distinct keys of the smallest hashes, or all of them, fewer.

    ``keys`` has one column, ``key``, which may repeat and be null. Only keys hashed below a cut are sorted; the cut falls as
    rows are added, so what meets in one task is some ``SPARE`` times ``count`` keys, whatever the table's size. Where keys repeat
    so much that too few lie below it, the cut rises until there are enough.
    """
    rows, share = keys.count(), 1.0
    if rows > SPARE * count:
        share = SPARE * count / rows
    while True:
        low = keys.select("key", _hash().alias("hash"))
        if share < 1:
            low = low.where(F.col("hash") < int(share * 2.0 ** 64) - (1 << 63))
        low = low.distinct()
        if share >= 1 or low.limit(count).count() == count:
            return low.orderBy("hash", "key").limit(count)
        share = min(1.0, share * RISE)


def _hash() -> Column:
    return F.xxhash64("key")


def sampled(rows: DataFrame, picked: DataFrame, value: Column) -> DataFrame:
    """(hash, value): of each picked key the least value of its rows, so that a key of many rows is one."""
    found = rows.join(picked.withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key")))
    return found.select("hash", value.alias("value")).groupBy("hash").agg(F.min("value").alias("value"))
