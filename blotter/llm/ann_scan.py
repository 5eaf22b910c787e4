"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Vectors are scaled to length one, so the largest cosine is the smallest distance, and turned by one
random rotation, so that the first d of D components are a random projection. A bounded sample
gives the centres of the lists (k-means); every vector is put into the list of its nearest
centre. A query probes the ``probes`` lists nearest to it. Inside a list the rotated vectors lie in
column blocks: a scan adds up partial squared distances block by block for all candidates still
alive and, after each, tests for every one the hypothesis that its distance is within the query's
k-th best so far; the partial distance, scaled by D/d, rejects it when it is above that bound by the
factor (1 + ``EPSILON`` / sqrt(d))**2. Survivors of all blocks get the exact cosine on the original
vectors in double precision.

Lists are split into blocks of about ``BLOCK_ROWS`` rows by row, and the
queries of a list into blocks of ``QUERY_ROWS``, so a list of any size, even one of a third of all
rows, is many small groups. The number of lists grows with the square root of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import sample_keys, sampled
from .store import stage
from .vectors import BLOCK_ROWS, QUERY_ROWS, best, clean, list_column, matrix, top_k

SAMPLE_ROWS, MAX_LISTS, ROUNDS, COLUMNS, EPSILON, SEED = 8192, 4096, 12, 16, 2.1, 11


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / scale
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def centres(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k-means centres of unit vectors; centres that lose all rows keep their place."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    found = distinct[rng.permutation(len(distinct))[:lists]]
    for _ in range(rounds):
        own = np.argmax(distinct @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, distinct)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        found = np.where(length > 0, sums / np.maximum(length, 1e-300), found)
    return found


def scan(query: np.ndarray, own: int, ids: np.ndarray, blocks: list[np.ndarray], k: int, cosine) -> np.ndarray:
    """Positions of up to k nearest candidates; ``blocks`` are columns of the rotated vectors.

    ``cosine(positions)`` gives the exact measure. The bound starts from the first candidates and
    tightens as rows of the block are finished.
    """
    dim = len(query)
    everyone = np.flatnonzero(ids != own)
    kept = np.zeros(0, np.int64)
    scores = np.zeros(0)
    bound = math.inf
    step = 64  # the first candidates set a bound; later ones come in larger runs
    at = 0
    while at < len(everyone):
        alive = everyone[at:at + step]
        at += len(alive)
        step = min(step * 4, 4096)
        partial = np.zeros(len(alive))
        done = 0
        for block in blocks:
            width = block.shape[1]
            diff = block[alive] - query[done:done + width]
            partial += np.einsum("ij,ij->i", diff, diff)
            done += width
            factor = (1 + EPSILON / math.sqrt(done)) ** 2 if done < dim else 1 + 1e-9
            passed = partial * (dim / done) <= bound * factor
            if not passed.all():
                alive, partial = alive[passed], partial[passed]
            if not len(alive):
                break
        if len(alive):
            kept = np.concatenate((kept, alive))
            scores = np.concatenate((scores, cosine(alive)))
            top = best(scores, ids[kept], k)
            kept, scores = kept[top], scores[top]
            if len(kept) == k:
                bound = max(0.0, 2 - 2 * scores[-1]) + 1e-12
    return kept


def search(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
           probes: float = 0.8, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k rows of largest cosine found for each query.

    ``probes`` is the share of the lists that a query probes (one list at least). A row whose key is the
    query's own takes no part in its search. Vectors that are null, zero, of another length than
    most, or hold null or non-finite components take no part on either side. Ties go to the smaller key;
    a row that occurs more than once is as
    many candidates. Empty tables give an empty result.
    """
    nonzero = F.exists("vec", lambda x: x != 0)
    base = stage(clean(rows, key, vector).where(nonzero), "ann-rows")
    size = base.count()
    if not size:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = clean(queries, key, vector).where(nonzero)
    lists = max(1, min(MAX_LISTS, math.isqrt(size) // 2))
    keyed = base.select(F.col("id").alias("key"), "vec")
    sample = sampled(keyed, sample_keys(keyed.select("key"), SAMPLE_ROWS), F.col("vec")).orderBy("hash").toArrow()
    middle = centres(unit(matrix(sample.column("value"))), lists, seed=seed)
    lists = len(middle)
    nearest = max(1, math.ceil(probes * lists))
    turn = rotation(middle.shape[1], seed)

    def assign(count: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vec = matrix(batch.column("vec"))
                if not len(vec):
                    continue
                near = unit(vec) @ middle.T
                own = np.argpartition(-near, count - 1, axis=1)[:, :count] if count < lists else np.tile(np.arange(lists), (len(vec), 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("vec"), list_column(own.astype(np.int32))], names=["id", "vec", "lists"])
        return run

    schema = "id long, vec array<double>, lists array<int>"
    filed = stage(base.mapInArrow(assign(1), schema).select("id", "vec", F.col("lists")[0].alias("list")), "ann-lists")
    probing = stage(asked.mapInArrow(assign(nearest), schema).select("id", "vec", F.explode("lists").alias("list")), "ann-queries")
    # A row for each list: how many blocks its rows and its queries are dealt to.
    blocks = filed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("row_blocks")).join(
        probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("query_blocks")), "list")
    blocks = stage(blocks, "ann-blocks")
    deal = F.xxhash64(F.monotonically_increasing_id())  # of a written table: repeated rows are dealt apart
    left = filed.join(F.broadcast(blocks), "list").select(
        "id", "vec", "list", F.pmod(deal, "row_blocks").cast("int").alias("row_block"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"))
    right = probing.join(F.broadcast(blocks), "list").select(
        "id", "vec", "list", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block"),
        F.pmod(deal, "query_blocks").cast("int").alias("query_block"))

    def probe(candidates: pa.Table, questions: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if candidates.num_rows and questions.num_rows:
            ids, vec = candidates.column("id").to_numpy(), matrix(candidates.column("vec"))
            length = np.sqrt((vec * vec).sum(axis=1))
            turned = unit(vec) @ turn
            columns = [np.ascontiguousarray(turned[:, a:a + COLUMNS]) for a in range(0, turned.shape[1], COLUMNS)]
            asking = matrix(questions.column("vec"))
            for own, q, t in zip(questions.column("id").to_pylist(), asking, unit(asking) @ turn):
                norm = math.sqrt((q * q).sum())

                def cosine(at, q=q, norm=norm):
                    return (vec[at] * q).sum(axis=1) / (length[at] * norm)

                hits = scan(t, own, ids, columns, k, cosine)
                out[0] += [own] * len(hits)
                out[1] += ids[hits].tolist()
                out[2] += cosine(hits).tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    by = ("list", "row_block", "query_block")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(probe, "query_id long, vec_id long, score double")
    return top_k(found, k)
