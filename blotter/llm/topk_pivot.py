"""Exact top-k inner products by elimination with a pivot table.

The largest inner product becomes a nearest-neighbour search: a row x gets the extra component
sqrt(M - |x|^2), M the largest squared length, and a query q the component 0; then
|q' - x'|^2 = |q|^2 + M - 2 q.x, so the nearest row has the largest product. Distances from every row to
many pivots (a bounded sample of rows) are computed once. For a query, the triangle inequality bounds
its distance to a row from below by the largest |d(q, p) - d(x, p)| over all pivots p. The
candidates of a block are taken in the order of that bound, and the search of the block stops when the
next bound is beyond the distance of the k-th best product known: no later row can reach it. Products
are integers and computed exactly; bounds get a slack for rounding. A first bound for every query
comes from the pivot rows themselves.

Rows are dealt to blocks of about ``BLOCK_ROWS`` by row, queries to blocks of ``QUERY_ROWS``; each pair
of blocks is one group of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stage
from .vectors import BLOCK_ROWS, QUERY_ROWS, best, clean, matrix, top_k

PIVOTS, CHUNK = 64, 128


def quantise(vectors: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of every component, as 64-bit integers."""
    return np.floor(scale * vectors).astype(np.int64)


def search_block(query: np.ndarray, own: int, to_pivots: np.ndarray, ids: np.ndarray, rows: np.ndarray, table: np.ndarray,
                 reach: float, k: int, known: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, scores) of the block's k best rows that can count, and how many were evaluated.

    ``reach`` is |q|^2 + M; ``known`` a product that k rows (of any block) are known to reach.
    """
    lower = np.abs(table - to_pivots).max(axis=1)
    lower = np.maximum(lower * (1 - 1e-9) - 1e-6, 0)
    most = (reach - lower * lower) / 2  # no row's product is above this
    most = most + 1e-9 * abs(reach) + 1e-6
    order = np.argsort(-most, kind="stable")
    order = order[ids[order] != own]
    kept, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = -math.inf if known is None else known
    done = 0
    while done < len(order) and most[order[done]] >= least:
        some = order[done:done + CHUNK]
        some = some[most[some] >= least]
        done += CHUNK
        kept = np.concatenate((kept, some))
        scores = np.concatenate((scores, rows[some] @ query))
        top = best(scores, ids[kept], k)
        kept, scores = kept[top], scores[top]
        if len(kept) == k:
            least = max(least, int(scores[-1]))
    return kept, scores, min(done, len(order))


def search(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
           scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer products, all if fewer.

    A row whose key is the query's own takes no part in its search; ties go to the smaller key; a row
    that occurs more than once is as many candidates. Vectors that are null, of another length than most, or
    hold null or non-finite components take no part. Empty tables give an empty result. Exact while
    products stay below 2**62 (components below about 2**27 after scaling).
    """
    base = stage(clean(rows, key, vector), "topk-rows")
    facts = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate(
        "vec", F.lit(0.0), lambda a, x: a + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))).alias("most")).first()
    spark = base.sparkSession
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = stage(clean(queries, key, vector), "topk-queries")
    sample = base.orderBy(F.xxhash64("id"), "id").select("id", "vec").limit(pivots).toArrow()
    most = float(facts["most"])
    pivot_ids = sample.column("id").to_numpy()
    pivot_rows = quantise(matrix(sample.column("vec")), scale)

    def lifted(vectors: np.ndarray) -> np.ndarray:
        v = vectors.astype(np.float64)
        return np.concatenate((v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0))[:, None]), axis=1)

    pivot_points = lifted(pivot_rows)

    def distances(points: np.ndarray) -> np.ndarray:
        out = np.empty((len(points), len(pivot_points)))
        for j, p in enumerate(pivot_points):
            d = points - p
            out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return out

    row_blocks = max(1, math.ceil(facts["n"] / BLOCK_ROWS))
    query_blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
    deal = F.xxhash64(F.monotonically_increasing_id())  # of a written table: repeated rows are dealt apart
    left = base.select("id", "vec", F.pmod(deal, F.lit(row_blocks)).cast("int").alias("row_block"),
                       F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    right = asked.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("row_block"),
                         F.pmod(deal, F.lit(query_blocks)).cast("int").alias("query_block"))

    def evaluate(candidates: pa.Table, questions: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if candidates.num_rows and questions.num_rows:
            ids = candidates.column("id").to_numpy()
            whole = quantise(matrix(candidates.column("vec")), scale)
            table = distances(lifted(whole))
            asking = quantise(matrix(questions.column("vec")), scale)
            points = np.concatenate((asking.astype(np.float64), np.zeros((len(asking), 1))), axis=1)
            for own, q, point, to_pivots in zip(questions.column("id").to_pylist(), asking, points, distances(points)):
                seeds = np.unique(pivot_ids[pivot_ids != own], return_index=True)[1]
                first = np.sort((pivot_rows[pivot_ids != own] @ q)[seeds])[::-1]
                known = int(first[k - 1]) if len(first) >= k else None
                hits, scores, _ = search_block(q, own, to_pivots, ids, whole, table, float((point * point).sum()) + most, k, known)
                out[0] += [own] * len(hits)
                out[1] += ids[hits].tolist()
                out[2] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), out)})

    by = ("row_block", "query_block")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(evaluate, "query_id long, vec_id long, score long")
    return top_k(found, k)
