"""Token-id files: every document compressed alone with one shared zstandard dictionary.

A store is a folder with two Parquet tables, written and committed by Spark:

- ``dictionary``: one row (dict_hash, dictionary), trained on the serialized id arrays of a bounded
  sample of documents (``SAMPLE_DOCS`` by smallest hash of the id, ``SAMPLE_CHARS`` characters from
  anywhere in each).
- ``blocks``: rows of up to ``BLOCK_DOCS`` documents in ascending key order: part and block numbers,
  the keys, token counts and byte offsets of the documents, the dictionary's hash, and the payload:
  one zstandard frame for each document. A document is read by its block's key range, its offset
  and the dictionary alone, without its neighbours.

Ids are serialized as little-endian unsigned 16-bit integers when the vocabulary allows it, else
as 32-bit ones; ``width`` records which.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import encoded
from .sampling import sample_keys, sampled

SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 400, 8_000, 32_768, 3
BLOCK_DOCS, BLOCK_BYTES = 256, 4 << 20

BLOCKS = ("part int, block int, keys array<bigint>, n_tokens array<int>, offsets array<bigint>, "
          "first_token long, width int, dict_hash string, payload binary")


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; too few samples to train on give their plain content instead."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.blake2b(dictionary, digest_size=16).hexdigest()


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _serialize(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def sample_texts(docs: DataFrame) -> DataFrame:
    """(text): a slice of each sampled document of (key, text); the key's hash says where in the whole text it begins.

    Keys are picked without their texts. A key that repeats gives the least of its slices.
    """
    begins = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    begin = (F.pmod(F.xxhash64("key", F.lit(1)), begins) + 1).cast("int")
    slices = sampled(docs, sample_keys(docs.select("key"), SAMPLE_DOCS), F.substring("text", begin, F.lit(SAMPLE_CHARS)))
    return slices.orderBy("hash").select(F.col("value").alias("text"))  # at most SAMPLE_DOCS rows


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int, key: str = "doc_id",
                text: str = "text", partitions: int | None = None) -> None:
    """Write ``docs`` (one row per document) as a store in ascending key order.

    Null texts are empty documents, which hold the end id alone. Rows with equal keys are all kept,
    ordered by their text; a null key sorts first. Further columns are not stored, whatever their names. An empty table
    gives a store without blocks.
    """
    spark = docs.sparkSession
    width = 2 if vocabulary <= 1 << 16 else 4
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    sample = sample_texts(docs).toArrow()
    parts: list[bytes] = []
    for _, ids, counts in encoded(sample.combine_chunks().to_batches(), tokenizer, end_id):
        parts += [_serialize(x, width) for x in np.split(ids, np.cumsum(counts)[:-1])]
    raw = train_dictionary(parts)
    name = dictionary_hash(raw)
    spark.createDataFrame([(name, bytearray(raw))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(
        f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw))
        schema = pa.schema([
            ("part", pa.int32()), ("block", pa.int32()), ("keys", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())),
            ("offsets", pa.list_(pa.int64())), ("first_token", pa.int64()), ("width", pa.int32()),
            ("dict_hash", pa.string()), ("payload", pa.binary())])
        keys: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = number = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, number, before
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).tolist()
            row = [part, number, list(keys), list(counts), offsets, before, width, name, b"".join(frames)]
            number, before, held = number + 1, before + sum(counts), 0
            keys.clear(), counts.clear(), frames.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for rows, ids, n in encoded(batches, tokenizer, end_id):
            at = 0
            for k, c in zip(rows.column("key").to_pylist(), n.tolist()):
                frames.append(zstd.compress(_serialize(ids[at:at + c], width)))
                keys.append(k), counts.append(c)
                held, at = held + len(frames[-1]), at + c
                if len(keys) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                    yield flush()
        if keys:
            yield flush()

    by = (partitions, "key") if partitions else ("key",)
    docs.repartitionByRange(*by).sortWithinPartitions("key", "text").mapInArrow(blocks, BLOCKS).write.option(
        "compression", "none").parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str, schema: str, handle) -> DataFrame:
    """``handle(keys, starts, counts, ids)`` of each block gives a record batch of ``schema``.

    ``ids`` are the block's ids one document after the other; ``starts`` count the ids of all
    documents before each one in the whole store. A dictionary that does not match a block's hash is
    an error.
    """
    stored = spark.read.schema("dict_hash string, dictionary binary").parquet(f"{path}/dictionary").first()
    name, raw = stored["dict_hash"], bytes(stored["dictionary"])
    if dictionary_hash(raw) != name:
        raise ValueError("the store's dictionary does not match its hash")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    last = F.col("first_token") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = blocks.groupBy("part").agg(F.max(last).alias("size"))  # a row for each file of the store
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn(
        "first_token", F.col("first_token") + F.col("before")).drop("before")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["dict_hash"] != name:
                    raise ValueError("a block was written with another dictionary")
                payload = memoryview(row["payload"])
                counts = np.array(row["n_tokens"], dtype=np.int64)
                texts = [zstd.decompress(payload[a:b]) for a, b in zip(row["offsets"][:-1], row["offsets"][1:])]
                ids = np.frombuffer(b"".join(texts), dtype="<u2" if row["width"] == 2 else "<u4").astype("<u4")
                if len(ids) != counts.sum():
                    raise ValueError("a block's frames do not hold its token counts")
                starts = row["first_token"] + np.cumsum(counts) - counts
                yield handle(row["keys"], starts, counts, ids)

    return blocks.mapInArrow(decode, schema)


def read_document(spark: SparkSession, path: str, key: int) -> list[np.ndarray]:
    """The ids of every document with this key, read from their blocks alone."""
    raw = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    zstd = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    found = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where(F.array_contains("keys", F.lit(key).cast("long")))
    at = F.posexplode(F.arrays_zip("keys", F.slice("offsets", F.lit(1), F.size("keys")).alias("a"),
                                   F.slice("offsets", F.lit(2), F.size("keys")).alias("b")))
    rows = found.select("width", "payload", at.alias("i", "doc")).where(F.col("doc.keys") == key).select(
        "width", F.expr("substring(payload, int(doc.a) + 1, int(doc.b - doc.a))").alias("frame")).collect()
    return [np.frombuffer(zstd.decompress(bytes(r["frame"])), "<u2" if r["width"] == 2 else "<u4").astype("<u4") for r in rows]


def crc_rows(keys, starts, counts, ids) -> pa.RecordBatch:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""
    import zlib

    raw = memoryview(np.ascontiguousarray(ids, dtype="<u4").tobytes())
    ends = np.cumsum(counts)
    crc = [zlib.crc32(raw[4 * (e - c):4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
        names=["doc_id", "start", "n_tokens", "ids_crc32"])
