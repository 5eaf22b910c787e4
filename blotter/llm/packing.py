"""Harmonic packing of token documents into sequences of a fixed length.

Sizes are sorted into reciprocal classes: class k holds pieces of at most ``capacity // k`` tokens,
and a sequence of class k takes exactly k of them. A document is cut, longest piece first, into
pieces of exactly ``capacity // k`` tokens while at least ``MIN_CUT`` are left; what remains is one
short tail in the class that fits it. So sequences of every class but the tails' are full to
within k tokens.

Every task fills its own sequences, without exchange, as documents stream by: the class alone
decides where a piece goes, and a task holds at most one open sequence for each class. What is
left open at its end (under one sequence for each class) goes to a group of ``GROUP`` tasks, which
packs all that its tasks left over, the longest first, into as few sequences as it finds.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoded
from .store import stage

CAPACITY, MIN_CUT, GROUP = 4096, 64, 16
#: Documents to a sequence, by class.
CLASSES = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, 4096)


def class_sizes(capacity: int) -> list[int]:
    """The largest piece of each class, descending."""
    return sorted({capacity // k for k in CLASSES if k <= capacity} | {1}, reverse=True)


def cut(length: int, sizes: list[int], least: int = MIN_CUT) -> list[int]:
    """Piece lengths of a document, longest first; all but the last are class sizes."""
    out = [sizes[0]] * (length // sizes[0])
    rest = length % sizes[0]
    for size in sizes[1:]:
        while rest >= size >= least:
            out.append(size)
            rest -= size
    if rest:
        out.append(rest)
    return out


def class_of(length: int, sizes: list[int]) -> int:
    """Size of the smallest class that takes a piece."""
    return sizes[bisect_right(sizes, -length, key=lambda s: -s) - 1]


def pack_rest(lengths: list[int], capacity: int, sizes: list[int]) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece: full classes first, then best fit, longest first."""
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    classes: dict[int, list[int]] = {}
    sequences = 0
    for i, length in enumerate(lengths):
        own = classes.setdefault(class_of(length, sizes), [])
        own.append(i)
        if len(own) == capacity // class_of(length, sizes):
            at = 0
            for j in own:
                place[j] = (sequences, at)
                at += lengths[j]
            sequences += 1
            own.clear()
    left = sorted((i for own in classes.values() for i in own), key=lambda i: (-lengths[i], i))
    rooms: list[tuple[int, int]] = []  # (room, sequence), ascending: under one sequence for each class
    for i in left:
        at = bisect_left(rooms, (lengths[i], -1))
        if at < len(rooms):
            room, sequence = rooms.pop(at)
        else:
            room, sequence = capacity, sequences
            sequences += 1
        place[i] = (sequence, capacity - room)
        insort(rooms, (room - lengths[i], sequence))
    return place


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row for each piece of each document's ids (``end_id`` last) and its place in a sequence.

    Columns: ``key``, start (ids of the document before the piece), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset. Null and empty texts are one end id. Every
    row of ``docs`` is packed, repeated ones too; other columns are left out. An empty table gives an
    empty result. Sequence ids are unique, not gapless. Which documents share a sequence depends on
    how the input is dealt to tasks; the written pieces fix it.
    """
    sizes = class_sizes(capacity)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "rest"]
    schema = f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, rest int"
    most = {s: capacity // s for s in sizes}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number = part << 32
        held: dict[int, list[tuple]] = {s: [] for s in sizes}
        for rows, ids, counts in encoded(batches, tokenizer, end_id):
            raw = memoryview(np.ascontiguousarray(ids, dtype="<u4").tobytes())
            out: list[tuple] = []
            at = 0
            for k, count in zip(rows.column("key").to_pylist(), counts.tolist()):
                start = 0
                for length in cut(count, sizes):
                    own = held[size := class_of(length, sizes)]
                    begin = 4 * (at + start)
                    own.append((k, start, length, bytes(raw[begin:begin + 4 * length]), count))
                    start += length
                    if len(own) == most[size]:
                        offset = 0
                        for piece in own:
                            out.append((*piece, number, offset, None))
                            offset += piece[2]
                        number += 1
                        own.clear()
                at += count
            if out:
                yield _batch(out)
        out = [(*piece, None, None, part // GROUP) for own in held.values() for piece in own]
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(docs.schema["key"].dataType), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
             pa.int64(), pa.int32()]

    def gather(group: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        place = pack_rest(lengths, capacity, sizes)
        first = (1 << 62) + (group[0].as_py() << 32)
        table = table.set_column(5, "sequence_id", pa.array([first + s for s, _ in place], pa.int64()))
        return table.set_column(6, "offset", pa.array([o for _, o in place], pa.int64()))

    pieces = stage(docs.mapInArrow(fill, schema), "packed")
    rest = pieces.where("rest IS NOT NULL").groupBy("rest").applyInArrow(gather, schema)
    return pieces.where("rest IS NULL").unionAll(rest).drop("rest").withColumnRenamed("key", key)
