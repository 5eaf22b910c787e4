"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every row's key is hashed to one of ``2**CELL_BITS`` equal arcs ("cells") of a ring. A cell
belongs to the shard that owns the next virtual node clockwise. A shard accepts a cell only while
its load stays within ``(1 + slack)`` times the mean load; a cell that finds its shard full
continues clockwise to the next shard with room. So no shard exceeds the bound (plus one cell
when a single cell is larger than all room left), and adding a shard moves only the cells that
change owner or overflow.

One aggregation gives the load of each cell: a table of at most 65,536 rows, whatever the input.
The walk round the ring runs over this bounded table; rows then join their cell's shard by
broadcast. Slots number the rows of a shard without gaps, from cell offsets plus the rank inside
the cell, so no shard's rows meet in one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stage

CELL_BITS = 16
CELLS = 1 << CELL_BITS


def ring(shards: int, replicas: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node on the 64-bit ring, clockwise."""
    nodes = []
    for shard in range(shards):
        for replica in range(replicas):
            digest = hashlib.blake2b(f"{shard}/{replica}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(digest, "big"), shard))
    return sorted(nodes)


def walk(loads: dict[int, int], shards: int, replicas: int = 128, slack: float = 0.01) -> dict[int, int]:
    """Shard of each loaded cell; cells are placed in ring order.

    A cell larger than the room left in every shard goes to the least loaded one.
    """
    nodes = ring(shards, replicas)
    places = [p for p, _ in nodes]
    bound = sum(loads.values()) * (1 + slack) / shards
    held = [0] * shards
    out = {}
    for cell in sorted(loads):
        load = loads[cell]
        at = bisect_left(places, cell << (64 - CELL_BITS))
        seen: set[int] = set()
        chosen = -1
        while len(seen) < shards:
            shard = nodes[at % len(nodes)][1]
            at += 1
            if shard in seen:
                continue
            seen.add(shard)
            if held[shard] + load <= bound:
                chosen = shard
                break
        if chosen < 0:
            chosen = min(range(shards), key=lambda s: (held[s], s))
        held[chosen] += load
        out[cell] = chosen
    return out


def cell_of(*key: Column | str) -> Column:
    """Ring cell of a key: the top bits of its 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - CELL_BITS).cast("int")


def shard_rows(rows: DataFrame, key: list[str], size: str, shards: int = 8, replicas: int = 128,
               slack: float = 0.01) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``key`` columns place a row on the ring; ``size`` is its load (null counts as 0). Input columns
    named ``shard`` or ``slot`` are replaced. Null keys hash like any value; equal keys stay
    together, so give columns that tell rows apart where one key may be hot. Repeated rows get
    slots of their own. An empty table gives an empty result. Reruns agree up to the order
    of rows that are equal in every key column and the size.
    """
    rows = stage(rows.drop("shard", "slot").withColumn("__cell", cell_of(*key)), "shards")
    load = F.coalesce(F.col(size), F.lit(0)).cast("long")
    cells = rows.groupBy("__cell").agg(F.sum(load).alias("load"), F.count(F.lit(1)).alias("n")).collect()  # <= CELLS rows
    placed = walk({c["__cell"]: c["load"] for c in cells}, shards, replicas, slack)
    filled = [0] * shards
    plan = []
    for c in sorted(cells, key=lambda c: c["__cell"]):
        shard = placed[c["__cell"]]
        plan.append((c["__cell"], shard, filled[shard]))
        filled[shard] += c["n"]
    plan = rows.sparkSession.createDataFrame(plan, "`__cell` int, shard int, `__base` long")
    rank = F.row_number().over(Window.partitionBy("__cell").orderBy(*key, size))
    return (
        rows.withColumn("__rank", rank)
        .join(F.broadcast(plan), "__cell")
        .withColumn("slot", F.col("__base") + F.col("__rank") - 1)
        .drop("__cell", "__rank", "__base")
    )
