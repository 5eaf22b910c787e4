"""Vectorised work on the UTF-8 bytes of an Arrow string column: words, hashes, byte windows.

Tasks receive text as Arrow batches. The bytes of a batch already lie in one buffer, so words are
found and hashed for the whole batch with numpy instead of one Python call per word. Only the
six ASCII white-space bytes (0x20, 0x09-0x0D) separate words; in UTF-8 these bytes never occur
inside another character, so byte-wise splitting is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so powers are invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
#: Text bytes handled at once in a task; a longer single text is handled alone, whole.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def lower(data: np.ndarray) -> np.ndarray:
    """``LOWER[data]``, without a look at a table for each byte."""
    return data | (data - np.uint8(0x41) < 26).view(np.uint8) << np.uint8(5)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a bijection on 64-bit values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have


@dataclass
class Spans:
    """Byte spans [start, end) of ``data`` and the row of the batch each belongs to."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def utf8(column) -> pa.Array:
    """One contiguous 64-bit-offset string array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.cast(pa.large_string())


def row_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): row i of the column holds bytes[offsets[i]:offsets[i+1]]; null is empty."""
    array = utf8(column)
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=array.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch of at most ``limit`` text bytes each (one row at least)."""
    off = row_bytes(batch.column(text))[1]
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Maximal runs of bytes that are no ASCII white space, never across rows."""
    n = len(data)
    rows = len(offsets) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return Spans(data, z, z, z)
    inside = (data != 0x20) & (data - np.uint8(0x09) > 4)  # no byte of SPACE
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True  # a row begins (or the data end) here
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Spans(data, start, end, np.repeat(np.arange(rows), np.diff(np.searchsorted(start, offsets))))


def span_hashes(spans: Spans, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, independent of where the span lies."""
    n = len(spans.data)
    value = np.empty(n + 1, dtype=np.uint64)
    value[0] = 0
    np.cumsum(_BYTE_VALUE[spans.data] * _power_table(_BASE, n + 1)[:n], out=value[1:])
    h = (value[spans.end] - value[spans.start]) * _power_table(_INVERSE, n + 1)[spans.start]
    length = (spans.end - spans.start).astype(np.uint64)
    return mix(h + mix(length + np.uint64(seed)))


def windows(row: np.ndarray, hashes: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words; a row with fewer words gives its whole sequence."""
    n = len(hashes)
    per_row = np.bincount(row, minlength=rows)
    begin = np.concatenate(([0], np.cumsum(per_row)))[:-1]
    out = np.zeros(n, dtype=np.uint64)
    place = np.arange(n) - begin[row]
    last = per_row[row] - place  # words from here to the end of the row
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    for j in range(size):
        term = mix(padded[j:j + n] + np.uint64((j + 1) * _BASE & (2**64 - 1)))
        out += np.where(last > j, term, np.uint64(0))
    keep = (last >= size) | (place == 0)
    return row[keep], mix(out[keep])


def distinct_pairs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), rows ascending and values ascending inside a row."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the next ``counts[i]`` items of ``values`` as raw bytes."""
    offsets = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))) * values.dtype.itemsize
    raw = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]
    ).cast(pa.binary())
