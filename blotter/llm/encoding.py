"""Exact, fast use of a public tokenizer over Arrow batches of whole texts.

Both tokenizers split a text into pieces before merging bytes, and no piece ever spans a change from a
word to the ASCII white space after it. So a text is cut into units there, each distinct unit of a
batch is encoded once by the tokenizers library, and the ids of a text are gathered by numpy.
Units seen before are kept in a bounded table in the worker (dropped whole when full: it
only saves time). The result equals ``encode(text)``; the tests compare them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textbytes import CHUNK_BYTES, SPACE, Spans, chunks, row_bytes, span_hashes, words

#: Units kept by a worker: about 16 bytes and the ids of each.
CACHE_UNITS = 2_000_000

# White space that is not one of the six ASCII bytes: the byte-level pattern may join it with
# ASCII white space, so texts that hold any are encoded directly.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# A unit that is surely one run of letters and one of punctuation under either pattern.
_PLAIN = re.compile(rb"( ?[A-Za-z]+)([!-&(-/:-@\[-`{-~]*)\Z")


class FastEncoder:
    """Encodes with one tokenizer file; ``spaced``: a single space belongs to the word after it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.spaced = bool(self._direct([" \n"])[0].size)  # byte-level keeps white space
        self.lower = self.tokenizer.normalizer is not None
        self.tails: dict[bytes, list[int]] = {}
        self.cache_units = CACHE_UNITS
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        if self.spaced:
            piece = piece.replace(" ", "Ġ")
        return [t.id for t in self.model.tokenize(piece.lower() if self.lower else piece)]

    def _encode_units(self, units: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = []
        rest, at = [], []
        for i, unit in enumerate(units):
            m = _PLAIN.match(unit)
            if m is None:
                rest.append(unit.decode("utf-8", "replace"))
                at.append(i)
                out.append(None)
                continue
            ids = self._piece(m[1].decode())
            if m[2]:
                tail = self.tails.get(m[2])
                if tail is None:
                    if len(self.tails) > 10_000:
                        self.tails.clear()
                    tail = self.tails[m[2]] = self._piece(m[2].decode())
                ids += tail
            out.append(ids)
        for i in range(0, len(rest), 1000):
            for j, e in zip(at[i:i + 1000], self.tokenizer.encode_batch(rest[i:i + 1000], add_special_tokens=False)):
                out[j] = e.ids
        return out

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> Spans:
        spans = words(data, offsets)
        if not self.spaced or not len(data):
            return spans
        # A space directly before a word joins it; other white space makes units of its own: all of
        # a run but its last byte, then that byte unless it joined; a run at the end stays whole.
        start = spans.start.copy()
        row_begin = offsets[spans.row]
        joins = (start > row_begin) & (data[np.maximum(start - 1, 0)] == 0x20)
        start[joins] -= 1
        gap = words_gaps(data, offsets)
        g_start, g_end, g_row = gap
        last = g_end == offsets[g_row + 1]
        tail_space = data[g_end - 1] == 0x20
        head_end = np.where(last, g_end, g_end - 1)
        one = ~last & ~tail_space  # the last byte of the run, alone
        heads = head_end > g_start
        s = np.concatenate((start, g_start[heads], g_end[one] - 1))
        e = np.concatenate((spans.end, head_end[heads], g_end[one]))
        r = np.concatenate((spans.row, g_row[heads], g_row[one]))
        order = np.argsort(s, kind="stable")
        return Spans(data, s[order], e[order], r[order])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, how many each row has)."""
        spans = self._units(data, offsets)
        rows = len(offsets) - 1
        if not len(spans.start):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        hashes, first, back = np.unique(span_hashes(spans), return_index=True, return_inverse=True)
        place = self._look_up(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = data.tobytes()
            units = [raw[a:b] for a, b in zip(spans.start[first[new]].tolist(), spans.end[first[new]].tolist())]
            if len(self.known) + len(new) > self.cache_units:
                self._forget()
                units_all = [raw[a:b] for a, b in zip(spans.start[first].tolist(), spans.end[first].tolist())]
                self._remember(hashes, self._encode_units(units_all))
            else:
                self._remember(hashes[new], self._encode_units(units))
            place = self._look_up(hashes)
        begin, count = self.begin[place][back], self.count[place][back]
        ends = np.cumsum(count)
        index = np.arange(ends[-1]) - np.repeat(ends - count - begin, count)
        n_ids = np.bincount(spans.row, weights=count, minlength=rows).astype(np.int64)
        return self.ids[index], n_ids

    def _look_up(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    def _remember(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for u in ids for x in u), np.uint32, int(count.sum()))
        begin = np.cumsum(count) - count + len(self.ids)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.begin, self.count = np.insert(self.begin, at, begin), np.insert(self.count, at, count)
        self.ids = np.concatenate((self.ids, flat))

    def encode_rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode`` for a string column; null is an empty text."""
        data, offsets = row_bytes(column)
        if not self.spaced or not _SUSPECT[data].any():
            return self.encode(data, offsets)
        texts = [t or "" for t in column.to_pylist()]
        odd = [i for i, t in enumerate(texts) if _OTHER_SPACE.search(t)]
        if not odd:
            return self.encode(data, offsets)
        direct = dict(zip(odd, self._direct([texts[i] for i in odd])))
        plain = pa.array(["" if i in direct else t for i, t in enumerate(texts)], pa.large_string())
        ids, counts = self.encode(*row_bytes(plain))
        begin = np.cumsum(counts) - counts
        parts = [direct[i] if i in direct else ids[begin[i]:begin[i] + counts[i]] for i in range(len(texts))]
        for i, d in direct.items():
            counts[i] = len(d)
        return np.concatenate(parts), counts


# Bytes that are, begin or (0xC2) may begin such white space.
_SUSPECT = np.zeros(256, dtype=bool)
_SUSPECT[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def words_gaps(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of ASCII white space inside rows."""
    inside = SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, side="right") - 1


_encoders: dict[str, FastEncoder] = {}


def encoder(path: str) -> FastEncoder:
    """The worker's encoder for a tokenizer file, made once."""
    if path not in _encoders:
        _encoders[path] = FastEncoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, text: str = "text",
            ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, counts) of slices of the batches; each document's ids end with ``end_id``."""
    enc = encoder(path)
    for batch in batches:
        for a, b in chunks(batch, text, 2 * CHUNK_BYTES):
            part = batch.slice(a, b - a)
            ids, counts = enc.encode_rows(part.column(text))
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
            yield part, ids, counts + 1
