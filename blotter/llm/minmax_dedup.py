"""Near-duplicate documents by min-max hashing, bands and exact verification.

A document's set holds its distinct 5-word shingles. Each of ``HASHES`` permutations of the shingles
gives two values, the set's least and greatest, so a signature of 2 * ``HASHES`` values costs half as
many hash evaluations; each value agrees between two sets with the probability of their Jaccard
similarity. ``BAND`` values make a band; documents that agree in a band are candidates. With 20 bands of
4 values, sets of similarity 0.85 miss all bands with a probability of 4e-7.

Documents with equal sets are one node (by a 128-bit fingerprint of the set). Candidates first compare one byte
of each value: a pair below ``LEAST_MATCH`` equal values of 80 is dropped (a pair of similarity 0.85 lies six
standard deviations above it). Those left are confirmed on the full sets. Components are found without all
pairs of a bucket (see ``linking``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import link
from .store import drop, stage
from .textbytes import LOWER, Spans, binary_rows, chunks, distinct_pairs, mix, row_bytes, span_hashes, windows, words

SHINGLE, HASHES, BAND, LEAST_MATCH, PARTS = 5, 40, 4, 48, 64
VALUES = 2 * HASHES
_rng = np.random.default_rng(2)
_FACTOR = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of a string column, each once; ASCII letters are lower-cased."""
    data, offsets = row_bytes(column)
    spans = words(data, offsets)
    hashes = span_hashes(Spans(LOWER[data], spans.start, spans.end, spans.row))
    return distinct_pairs(*windows(spans.row, hashes, len(offsets) - 1, SHINGLE))


def signatures(row: np.ndarray, shingle: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their least and greatest values under each permutation)."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros((0, VALUES), np.uint64)
    begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    out = np.empty((len(begin), VALUES), dtype=np.uint64)
    for j in range(HASHES):
        value = shingle * _FACTOR[j] + _SHIFT[j]
        value ^= value >> np.uint64(32)
        value *= _FACTOR[-1 - j]
        out[:, 2 * j] = np.minimum.reduceat(value, begin)
        out[:, 2 * j + 1] = np.maximum.reduceat(value, begin)
    return row[begin], out


def bands(signature: np.ndarray) -> np.ndarray:
    """(rows, bands) bucket numbers; the band is part of the hash.

    Bands take values of four different permutations, half of them least and half greatest.
    """
    order = np.arange(VALUES).reshape(HASHES, 2)
    mixed = np.concatenate((order[::2], order[1::2, ::-1])).T.reshape(-1, BAND)
    out = np.empty((len(signature), VALUES // BAND), dtype=np.uint64)
    for j, own in enumerate(mixed):
        h = np.full(len(signature), j + 1, dtype=np.uint64)
        for i in own:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, i])
        out[:, j] = h
    return out


_SKETCH = "key long, text_hash long, n_shingles long, high long, low long, signature binary, buckets array<bigint>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch):
            part, rows = batch.slice(a, b - a), b - a
            row, shingle = shingles(part.column("text"))
            n = np.bincount(row, minlength=rows)
            have, signature = signatures(row, shingle, rows)
            prints = np.zeros((rows, 2), dtype=np.uint64)
            if len(have):
                begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                prints[have, 0] = np.add.reduceat(mix(shingle + np.uint64(17)), begin)
                prints[have, 1] = np.add.reduceat(mix(shingle * np.uint64(0x9E3779B97F4A7C15)), begin)
            small = np.zeros((rows, VALUES), dtype=np.uint8)
            small[have] = (mix(signature) >> np.uint64(56)).astype(np.uint8)
            count = np.zeros(rows, np.int64)
            count[have] = VALUES // BAND
            offsets = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("text_hash"), pa.array(n.astype(np.int64)), pa.array(prints[:, 0].astype(np.int64)),
                 pa.array(prints[:, 1].astype(np.int64)), binary_rows(small.ravel(), np.full(rows, VALUES)),
                 pa.ListArray.from_arrays(offsets, pa.array(bands(signature).ravel().astype(np.int64)))],
                names=["key", "text_hash", "n_shingles", "high", "low", "signature", "buckets"])


def near_duplicates(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, n_shingles, component_id, kept) of every row of ``docs``.

    ``text_hash`` is Spark's xxhash64 of the text; with the key it tells rows of one key apart.
    Documents are linked if 100 * |intersection| >= percent * |union| of their sets. component_id is
    the least key reachable, the document's own included. A document with fewer than 5 words has
    its whole sequence as one shingle; one without words (null, empty) has an empty set and is linked with
    nothing. ``key`` holds whole numbers; rows with a null key are left out of links and get a null
    component, kept. Rows that share a key but not their text stand for themselves; of a component one text of the
    least key is kept. Repeated rows are all returned, alike. An empty table gives an empty result.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    sketches = stage(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketch, _SKETCH), "sketches")
    # One node for each distinct set, and the least (key, text_hash) that has it.
    nodes = sketches.where("n_shingles > 0 AND key IS NOT NULL").groupBy("high", "low", "n_shingles").agg(
        F.min(F.struct("key", "text_hash")).alias("least"), F.first("signature").alias("signature"), F.first("buckets").alias("buckets"))
    nodes = stage(nodes.withColumn("id", F.monotonically_increasing_id()), "sketch-nodes")
    members = nodes.select(F.explode("buckets").alias("bucket"), "id").distinct()
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stage(members.join(shared, "bucket", "left_semi"), "shared-buckets")
    # The whole texts of the documents that have a candidate, fetched once.
    wanted = nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "least.key", "least.text_hash")
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["key", "text_hash"]).groupBy("id").agg(
        F.min("text").alias("text"))
    texts = stage(texts, "candidate-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        return confirm(estimate(pairs, nodes, percent), texts, percent)

    found = link(members, verify, lambda ids: reachable(ids, texts, percent))
    drop(members, texts)
    by_set = nodes.select("high", "low", "n_shingles", "id", "least").join(found, "id", "left").withColumn(
        "root", F.coalesce("root", "id"))
    firsts = by_set.groupBy("root").agg(F.min("least").alias("first"))
    by_set = by_set.join(firsts, "root").select("high", "low", "n_shingles", "first")
    out = sketches.select("key", "text_hash", "n_shingles", "high", "low").join(by_set, ["high", "low", "n_shingles"], "left")
    linked = F.col("key").isNotNull() & (F.col("n_shingles") > 0)
    own = (F.col("key") == F.col("first.key")) & (F.col("text_hash") == F.col("first.text_hash"))
    return out.select(F.col("key").alias(key), "text_hash", "n_shingles",
                      F.when(linked, F.col("first.key")).otherwise(F.col("key")).alias("component_id"),
                      F.when(linked, own).otherwise(True).alias("kept"))


def reachable(ids: DataFrame, texts: DataFrame, percent: int):
    """Bounds for ``link``: of each set, how many shingles occur in another component, by part.

    The shingles fall into ``PARTS`` parts by their hash. The intersection of two sets of different
    components holds only shingles that occur in another one, and in each part at most as many as the
    set that has fewer of them: a heavily edited copy has too few to be linked with anything, and copies edited in
    different places have too few in common.
    """
    texts = texts.join(ids, "id")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch):
                part = batch.slice(a, b - a)
                row, shingle = shingles(part.column("text"))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(shingle.astype(np.int64)), part.column("id").take(at), part.column("comp").take(at)],
                                                 names=["shingle", "id", "comp"])

    single = texts.select("id", "comp", "text").mapInArrow(spread, "shingle long, id long, comp long")
    common = single.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    outside = single.join(common.select("shingle", F.lit(True).alias("outside")), "shingle", "left").groupBy("id").agg(
        F.count(F.lit(1)).alias("own"), F.collect_list(F.when(F.col("outside"), F.col("shingle"))).alias("shingles"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            part = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(PARTS)
            row = np.repeat(np.arange(len(size)), size)
            counts = np.bincount(row * PARTS + part.astype(np.int64), minlength=len(size) * PARTS)
            offsets = pa.array(np.arange(0, (len(size) + 1) * PARTS, PARTS), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("own"), pa.array(size.astype(np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))], names=["id", "own", "outside", "parts"])

    bounds = outside.where(100 * F.size("shingles") >= percent * F.col("own")).mapInArrow(
        count, "id long, own long, outside long, parts array<int>")

    def allowed(one: str, two: str):
        def similar(most):
            return 100 * most >= percent * (F.col(f"{one}.own") + F.col(f"{two}.own") - most)

        common = F.aggregate(F.zip_with(F.col(f"{one}.parts"), F.col(f"{two}.parts"), lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
        return similar(F.least(F.col(f"{one}.outside"), F.col(f"{two}.outside"))) & similar(common)

    return bounds, allowed


def estimate(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes and signatures allow the similarity asked for."""
    one = nodes.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("s_a"))
    two = nodes.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("s_b"))
    near = pairs.join(one, "a").join(two, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, VALUES) for c in ("s_a", "s_b"))
            keep = pa.array((a == b).sum(axis=1) >= LEAST_MATCH)
            yield batch.select(["a", "b"]).filter(keep)

    return near.select("a", "b", "s_a", "s_b").mapInArrow(agree, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough; ``texts`` has (id, text)."""
    pairs = stage(pairs, "pairs")
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("t_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("t_b"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch, "t_a"):
                part, rows = batch.slice(a, b - a), b - a
                row, shingle = (np.concatenate(x) for x in zip(shingles(part.column("t_a")), shingles(part.column("t_b"))))
                size = np.bincount(row, minlength=rows)
                union = np.bincount(distinct_pairs(row, shingle)[0], minlength=rows)
                yield part.select(["a", "b"]).filter(pa.array(100 * (size - union) >= percent * union))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "t_a", "t_b").mapInArrow(similar, "a long, b long")
