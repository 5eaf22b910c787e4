"""Language-model scoring with a probabilistic suffix tree over words.

A text is the sequence of its words (ASCII letters lower-cased) and an end, which also stands before
its first word. Symbols are the distinct training tokens and one symbol for every unseen word.

- Root: a training token of count c has (c - d) / N, the unseen word d * V / N; N counts the tokens, V
  the distinct ones, and d = n1 / (n1 + 2 * n2) comes from the tokens seen once and twice.
- Contexts of up to ``DEPTH`` tokens, any tokens: one that occurs ``LEAST_COUNT`` times or more is kept
  if its next-token distribution differs from that of its longest proper suffix, n * KL >=
  ``DIVERGENCE`` nats (n: its count), or if it is the suffix of a kept one. Neither depends on the corpus's size, so
  the tree grows with it.
- A state's distribution is smoothed towards that of its suffix with the weight of as many
  observations as it has distinct next tokens (Witten and Bell). Every next token seen has its own count.
- Scoring: the state at a token is the longest kept suffix of what precedes it. The score is the sum of
  the log10 probabilities; the base score is that of the smoothed unigram counts.

Counts cover every training text. Tokens and contexts are 64-bit hashes; words, states and next-token
counts are tables and are neither collected nor broadcast.

1. Texts are cut once, into chunks: distinct words, and places in them. The counts of a chunk's words come back to it.
2. Each position goes, with its three words before, its next word and that word's count, to the bucket of the last
   word before it, in ``PASSES`` passes over the buckets. A context and its suffixes share that word, so a bucket
   counts and keeps its own contexts. The gain is at most n ln(m / n) <= m / e (m: the suffix's count), so what
   cannot reach ``DIVERGENCE`` is not counted further. Positions after a word of more than ``HOT`` do not fit one task and
   are counted as rows, by context and next word (``grow``).
3. Scoring deals the positions of the texts in the same way, to the bucket's part of the tree, and adds up by text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, stage
from .textbytes import LOWER, Spans, chunks, mix, row_bytes, span_hashes, words

DEPTH, LEAST_COUNT, DIVERGENCE = 3, 2, 20.0
#: Tokens of a chunk, of a bucket, and of a word that is too frequent for a bucket; passes over the buckets.
CODED, BUCKET, HOT, PASSES = 9 << 18, 1 << 20, 1 << 22, 4
#: A context's gain is at most its suffix's count by e; the rest is for rounding.
LEAST_SUFFIX = DIVERGENCE * np.e * (1 - 1e-9)
OTHER = -1  # in ``Model.after``, the unseen word
END = int(mix(np.array([1], np.uint64)).view(np.int64)[0])
CONTEXTS = [f"c{d}" for d in range(1, DEPTH + 1)]


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every token: the words of each row in order, then its end."""
    data, offsets = row_bytes(column)
    spans = words(data, offsets)
    rows = len(offsets) - 1
    hashes = span_hashes(Spans(LOWER[data], spans.start, spans.end, spans.row)).view(np.int64)
    ends = np.cumsum(np.bincount(spans.row, minlength=rows))
    return np.insert(spans.row, ends, np.arange(rows)), np.insert(hashes, ends, END)


def contexts(row: np.ndarray, hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(hash of the context of each depth, depth that there is) of every token.

    Contexts that would reach beyond the text have hashes that no other context has.
    """
    h = hashes.view(np.uint64)
    n, place = len(h), np.arange(len(h)) - np.searchsorted(row, row)
    before = np.concatenate((np.zeros(1, np.uint64), h[:-1]))[:n]
    before[place == 0] = np.int64(END).view(np.uint64)  # an end precedes the first token
    out, context = [], np.zeros(n, np.uint64)
    for depth in range(DEPTH):
        back = np.zeros(n, np.uint64)
        back[depth:] = mix(before[:max(n - depth, 0)] + np.uint64(depth + 1))
        back[place < depth] = 0
        context = mix(context * np.uint64(0x9E3779B97F4A7C15) + back)
        out.append(context.view(np.int64))
    return out, np.minimum(place + 1, DEPTH)


def _window(context: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hash of the deepest context and the next token."""
    return mix(context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(hashes.view(np.uint64))).view(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0, byte by byte in planes, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.empty((width, len(values)), np.uint8)
    for k in range(width):
        planes[k] = (values >> (8 * k)) & 255 if k else values & 255
    return len(values).to_bytes(7, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, kind: type = np.int64) -> np.ndarray:
    n, width = _length(blob), blob[7]
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob[8:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = planes[0].astype(kind)
    for k in range(1, width):
        out |= planes[k].astype(kind) << kind(8 * k)
    return out


def _length(blob: bytes) -> int:
    return int.from_bytes(blob[:7], "little")


def _raw(blob: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(blob, kind)


def _rows(columns: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in columns.values()], names=list(columns))


def _share(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash."""
    return ((hashes.view(np.uint64) >> np.uint64(1)) % np.uint64(parts)).astype(np.int64)


_CODED = "words binary, ids binary, lengths binary, size long, kinds long"


def _code(kind: str):
    """Texts as chunks: the distinct hashes, most frequent first, the place in them of each token, tokens of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        keys, lengths, found = [], [], []

        def out() -> pa.RecordBatch:
            nonlocal number
            coded = pa.array(np.concatenate(found)).dictionary_encode()
            word, place = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            order = np.argsort(-np.bincount(place), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            key, length = pa.concat_arrays(keys), np.concatenate(lengths)
            number += 1
            columns = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key),
                       pa.array([word[order].tobytes()], pa.binary()), pa.array([_pack(rank[place])], pa.binary()),
                       pa.array([_pack(length)], pa.binary()), pa.array([len(place)]), pa.array([len(word)])]
            for held in (keys, lengths, found):
                held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "keys", "words", "ids", "lengths", "size", "kinds"])

        for batch in batches:
            for a, b in chunks(batch):
                part = batch.slice(a, b - a)
                row, hashes = tokens(part.column("text"))
                keys.append(part.column("key"))
                lengths.append(np.bincount(row, minlength=b - a))
                found.append(hashes)
                if sum(map(len, found)) >= CODED:
                    yield out()
        if found:
            yield out()
    return run, f"chunk long, keys array<{kind}>, {_CODED}"


def _terms(parts: int):
    """Each chunk's words and how often they occur there, by part of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                word = _raw(r["words"])
                n, part = np.bincount(_unpack(r["ids"]), minlength=len(word)), _share(word, parts)
                each = [(p, np.flatnonzero(part == p)) for p in np.unique(part).tolist()]
                yield _rows({"part": (pa.int64(), [p for p, _ in each]), "chunk": (pa.int64(), [r["chunk"]] * len(each)),
                             "words": (pa.binary(), [word[i].tobytes() for _, i in each]),
                             "n": (pa.binary(), [_pack(n[i]) for _, i in each])})
    return run


_TERMS = "part long, chunk long, words binary, n binary"


def _sum_terms(table: pa.Table, given: bool) -> pa.Table:
    """One part: for each chunk the counts of its words, and without a chunk all words and counts.

    If counts are ``given``, by rows without a chunk, they hold, and other words have 0.
    """
    rows = table.to_pylist()
    word = [_raw(r["words"]) for r in rows]
    known, place = np.unique(np.concatenate(word), return_inverse=True)
    n = [_unpack(r["n"]) for r in rows]
    ends = np.cumsum([0, *map(len, word)])
    count = np.zeros(len(known), np.int64)
    for k, r in enumerate(rows):
        if (r["chunk"] is None) == given:
            np.add.at(count, place[ends[k]:ends[k + 1]], n[k])
    part = rows[0]["part"]
    own = [(r["chunk"], None, _pack(count[place[ends[k]:ends[k + 1]]])) for k, r in enumerate(rows) if r["chunk"] is not None]
    own += [] if given else [(None, known.tobytes(), _pack(count))]
    return pa.table({"part": pa.array([part] * len(own), pa.int64()), "chunk": pa.array([c for c, _, _ in own], pa.int64()),
                     "words": pa.array([w for _, w, _ in own], pa.binary()), "n": pa.array([x for _, _, x in own], pa.binary())})


def _known_terms(parts: int):
    """Words and counts of a model, by part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = batch.column("hash").to_numpy(), batch.column("c").to_numpy()
            part = _share(word, parts)
            each = [(p, np.flatnonzero(part == p)) for p in np.unique(part).tolist()]
            yield _rows({"part": (pa.int64(), [p for p, _ in each]), "chunk": (pa.int64(), [None] * len(each)),
                         "words": (pa.binary(), [word[i].tobytes() for _, i in each]),
                         "n": (pa.binary(), [_pack(n[i]) for _, i in each])})
    return run


def _known_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(_raw(r["words"])), pa.array(_unpack(r["n"]))], names=["hash", "c"])


def _counted(docs: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame, int]:
    """(chunks of the texts, each with its words' counts; the words' table; parts of the words).

    The counts are those of ``seen`` or, without it, of the texts.
    """
    run, schema = _code(docs.schema["key"].dataType.simpleString())
    coded = stage(docs.mapInArrow(run, schema), "tree-chunks")
    parts = max(1, -(-(coded.agg(F.sum("kinds")).first()[0] or 0) // BUCKET))
    terms = coded.select("chunk", "words", "ids").mapInArrow(_terms(parts), _TERMS)
    if seen is not None:
        terms = terms.unionAll(seen.select("hash", "c").mapInArrow(_known_terms(parts), _TERMS))
    given = seen is not None
    terms = stage(terms.groupBy("part").applyInArrow(lambda t: _sum_terms(t, given), _TERMS), "tree-words")
    counts = terms.where("chunk IS NOT NULL").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("counts"))
    whole = stage(coded.join(counts, "chunk"), "tree-coded")
    drop(coded)
    return whole, terms, parts


@dataclass
class _Chunk:
    """A chunk's words, their counts, and of each token its place in the words and that of up to three tokens before it."""

    words: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray

    @classmethod
    def read(cls, r: dict, parts: int) -> "_Chunk":
        word = _raw(r["words"])
        count = np.zeros(len(word), np.int64)
        count[np.argsort(_share(word, parts), kind="stable")] = np.concatenate([_unpack(p["n"]) for p in r["counts"]])
        return cls(word, count, _unpack(r["ids"], np.int32), _unpack(r["lengths"]))

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    def before(self) -> list[np.ndarray]:
        """The tokens before each token, nearest first; -1 where they would reach beyond the text."""
        starts = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(self.ids), dtype=np.int32) - np.repeat(starts.astype(np.int32), self.lengths)
        last = np.concatenate((self.ids[:1], self.ids[:-1]))
        last[starts] = np.flatnonzero(self.words == END)[0]  # an end precedes the first token
        out = [last]
        for depth in range(1, DEPTH):
            far = np.full(len(last), -1, np.int32)
            far[depth:] = last[:-depth]
            far[place < depth] = -1
            out.append(far)
        return out


def _longer(context: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Hashes of contexts of a depth: those of their suffixes, and the word before."""
    back = mix(word.view(np.uint64) + np.uint64(depth))
    return mix(context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + back).view(np.int64)


def _after(word: np.ndarray) -> np.ndarray:
    """Hash of the context that a word alone is."""
    return _longer(np.zeros(len(word), np.int64), word, 1)


_BLOBS = "bucket long, depth int, chunk long, words binary, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary, b5 binary"


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    """``_BLOBS``, of positions (words' counts, words before, next, rows) or of a depth (contexts, suffixes, totals, kinds, next, n)."""
    types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 7]
    names = [c.split()[0] for c in _BLOBS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _positions(parts: int, buckets: int, number: int, left: list[int]):
    """The positions of every chunk by the bucket of the last word, for the buckets of one pass.

    Those after the words ``left`` or after a word that is no context are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                chunk = _Chunk.read(r, parts)
                bucket = _share(_after(chunk.words), buckets)
                bucket[(bucket % PASSES != number) | (chunk.counts < LEAST_COUNT) | np.isin(chunk.words, np.array(left, np.int64))] = -1
                before, row = chunk.before(), chunk.rows
                own = bucket.astype(np.int32)[before[0]]
                order = np.flatnonzero(own >= 0)
                own = own[order]
                turn = np.argsort(own.astype(np.uint16 if buckets < 1 << 16 else np.int32), kind="stable")
                order, own = order[turn], own[turn]
                ends = np.concatenate((np.flatnonzero(np.diff(own)) + 1, [len(own)])) if len(own) else []
                rows, a = [], 0
                for b in ends:
                    at = order[a:b]
                    near = [*(w[at] for w in before), chunk.ids[at]]
                    used = np.zeros(len(chunk.words) + 1, bool)
                    for w in near:
                        used[w] = True
                    used[-1] = False  # where there is no word
                    word = np.flatnonzero(used)
                    short = np.zeros(len(used), np.int32)
                    short[word] = np.arange(len(word)) + 1
                    rows.append((int(own[a]), DEPTH + 1, r["chunk"], chunk.words[word].tobytes(), _pack(chunk.counts[word]),
                                 _join([_pack(short[w]) for w in near[:-1]]), _pack(short[near[-1]] - 1),
                                 _pack(np.diff(row[at], prepend=0)), None, None))
                    a = b
                if rows:
                    yield _blobs(rows)
    return run


def _join(blobs: list[bytes]) -> bytes:
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def _split(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at:at + 8], "little")
        out.append(blob[at + 8:at + 8 + n])
        at += 8 + n
    return out


def _find(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted array, or -1."""
    if not len(known):
        return np.full(len(asked), -1)
    bits = len(asked).bit_length()
    if len(asked) and asked.min() >= -1 and int(asked.max()) < 1 << (62 - bits):  # place and value in one number sort faster
        both = np.sort((asked + 1 << bits) | np.arange(len(asked)))
        order, sorted_ = both & (1 << bits) - 1, (both >> bits) - 1
    else:
        order = np.argsort(asked)
        sorted_ = asked[order]
    at = np.minimum(np.searchsorted(known, sorted_), len(known) - 1)
    out = np.empty(len(asked), np.int64)
    out[order] = np.where(known[at] == sorted_, at, -1)
    return out


def _kept(bucket: int, depth: int, context: np.ndarray, suffix: np.ndarray, total: np.ndarray,
          state: np.ndarray, word: np.ndarray, token: np.ndarray, n: np.ndarray) -> tuple:
    """States and their counts, as one row of ``_BLOBS``: states by hash, counts by state and next word.

    ``token`` are places in ``word``, which is sorted; words that follow nothing are left out.
    """
    order = np.argsort(context)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    used = np.zeros(len(word), bool)
    used[token] = True
    word, place = word[used], (np.cumsum(used, dtype=np.int32) - 1)[token]
    turn = np.argsort(rank[state] * len(word) + place)
    return (bucket, depth, None, word.tobytes(), context[order].tobytes(), suffix[order].tobytes(), _pack(total[order]),
            _pack(np.bincount(rank[state], minlength=len(order))), _pack(place[turn]), _pack(n[turn]))


def _grow_bucket(table: pa.Table, positions: int) -> pa.Table:
    """The contexts that the tests keep, of those that end in the words of a bucket."""
    blobs = {k: [memoryview(b.as_buffer()) for b in table.column(k)] for k in ("words", "b0", "b1", "b2")}
    words = [_raw(b) for b in blobs["words"]]
    ends = np.cumsum([0, *map(len, words)])
    word, place = np.unique(np.concatenate(words), return_inverse=True)
    count = np.zeros(len(word), np.int64)
    count[place] = np.concatenate([_unpack(b) for b in blobs["b0"]])
    place = place.astype(np.int32)
    size = np.cumsum([0, *(_length(b) for b in blobs["b2"])])
    before = [np.empty(size[-1], np.int32) for _ in range(DEPTH)]
    following = np.empty(size[-1], np.int32)
    for k, e in enumerate(ends[:-1]):
        at = slice(size[k], size[k + 1])
        for b, w in zip(before, _split(blobs["b1"][k])):
            w = _unpack(w, np.int32)
            b[at] = np.where(w == 0, -1, place[e + w - 1])
        following[at] = place[e + _unpack(blobs["b2"][k], np.int32)]
    del words, place
    kinds = len(word)
    levels = []  # (hash, place of the suffix, total; state, next and n of each count; whether it differs)
    own = before[0]
    at = np.bincount(own, minlength=kinds)
    up, hashes, totals = np.zeros(kinds, np.int64), _after(word), at
    can = at >= LEAST_COUNT
    for depth in range(1, DEPTH + 1):
        if depth > 1:
            parent = levels[-1]
            ask = (before[depth - 1] >= 0) & (parent[2] >= LEAST_SUFFIX)[own]
            before, following, own = [b[ask] for b in before], following[ask], own[ask]
            key, own, totals = np.unique(own.astype(np.int64) * kinds + before[depth - 1], return_inverse=True, return_counts=True)
            up = key // kinds
            m = parent[2][up]
            hashes = _longer(parent[0][up], word[key % kinds], depth)
            can = (totals >= LEAST_COUNT) & (
                (totals * np.log(m / totals) >= DIVERGENCE * (1 - 1e-9)) | (totals >= LEAST_SUFFIX))
        ask, dense = can[own], np.cumsum(can, dtype=np.int32) - 1
        if not ask.all():
            before, following, own = [b[ask] for b in before], following[ask], own[ask]
        own = dense[own]
        hashes, up, totals = hashes[can], up[can], totals[can]
        key = own * np.int64(kinds) + following
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        n = np.diff(first, append=len(key))
        key = key[first]
        state, token = (key // kinds).astype(np.int32), (key % kinds).astype(np.int32)
        del key, first, ask
        if depth == 1:
            share = count[token] / positions
        else:
            above = _find(parent[3] * np.int64(kinds) + parent[4], up[state] * kinds + token)
            share = parent[5][above] / parent[2][parent[3][above]]
        share = n / totals[state] / share
        np.log(share, out=share)
        share *= n
        gain = np.bincount(state, share, minlength=len(totals))
        del share
        levels.append((hashes, up, totals, state, token, n, gain >= DIVERGENCE))
    del before, following, own, parent
    out, wanted = [], np.zeros(0, np.int64)
    for depth in range(DEPTH, 0, -1):  # a kept context's suffixes are kept
        hashes, up, totals, state, token, n, keep = levels.pop()
        keep[wanted] = True
        wanted = up[keep]
        if keep.any():
            dense, some = np.cumsum(keep) - 1, keep[state]
            suffix = levels[-1][0][wanted] if depth > 1 else np.zeros(len(wanted), np.int64)
            out.append(_kept(table.column("bucket")[0].as_py(), depth, hashes[keep], suffix, totals[keep], dense[state[some]], word, token[some], n[some]))
    return pa.Table.from_batches([_blobs(out)])


def _hot_windows(parts: int, hot: list[int]):
    """Every distinct window after some words in a chunk: its contexts, its next token, how often it occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                chunk = _Chunk.read(r, parts)
                own, depth = contexts(chunk.rows, chunk.words[chunk.ids])
                at = np.flatnonzero(np.isin(chunk.words, np.array(hot, np.int64))[chunk.before()[0]])
                following = chunk.words[chunk.ids[at]]
                _, first, n = np.unique(_window(own[-1][at], following), return_index=True, return_counts=True)
                columns = [*(c[at][first] for c in own), following[first], depth[at][first].astype(np.int32), n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*CONTEXTS, "next", "depth", "n"])
    return run


_WINDOWS = ", ".join(f"{c} long" for c in CONTEXTS) + ", next long, depth int, n long"


def _kept_rows(table: pa.Table) -> pa.Table:
    """The states of one bucket and depth, from rows of their counts."""
    c = {k: table.column(k).to_numpy() for k in ("context", "suffix", "total", "next", "n")}
    context, first, state = np.unique(c["context"], return_index=True, return_inverse=True)
    bucket, depth = table.column("bucket")[0].as_py(), table.column("depth")[0].as_py()
    word, token = np.unique(c["next"], return_inverse=True)
    return pa.Table.from_batches([_blobs([
        _kept(bucket, depth, context, c["suffix"][first], c["total"][first], state, word, token, c["n"])])])


def _state_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            columns = [_raw(r["b0"]), _raw(r["b1"]), _unpack(r["b2"]), _unpack(r["b3"])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["context", "suffix", "total", "kinds"])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            columns = [np.repeat(_raw(r["b0"]), _unpack(r["b3"])), _raw(r["words"])[_unpack(r["b4"])], _unpack(r["b5"])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["context", "next", "n"])


@dataclass
class Model:
    """Tables of the words (hash, c) and, by depth, of states (context, suffix, total, kinds) and counts (context, next, n).

    Both are read from ``tree``, which holds them by bucket of the context's last word. Positions of a bucket with a frequent
    word are scored by as many tasks as ``spread`` says.
    """

    tokens: int
    types: int
    discount: float
    known: DataFrame
    states: list[DataFrame]
    counts: list[DataFrame]
    tree: DataFrame
    buckets: int
    spread: dict[int, int]

    @property
    def unseen(self) -> float:
        return self.discount * max(self.types, 1) / self.tokens if self.tokens else 1.0

    # What follows collects the tables, to look at small models.
    @cached_property
    def words(self) -> "Words":
        got = sorted(((r.c, r.hash) for r in self.known.collect()), reverse=True)
        return Words(np.array([h for _, h in got], np.int64), np.array([c for c, _ in got], np.int64))

    @cached_property
    def _collected(self) -> list[tuple[dict, dict]]:
        return [({r.context: (r.suffix, r.total, r.kinds) for r in s.collect()}, {(r.context, r.next): r.n for r in c.collect()})
                for s, c in zip(self.states, self.counts)]

    @cached_property
    def contexts(self) -> list[np.ndarray]:
        return [np.array(sorted(s), np.int64) for s, _ in self._collected]

    @cached_property
    def parent(self) -> np.ndarray:
        """Of each state, 0 being the root."""
        at, up = {(0, None): 0}, [0]
        for depth, own in enumerate(self.contexts, 1):
            for c in own.tolist():
                at[depth, c] = len(up)
                up.append(at[depth - 1, self._collected[depth - 1][0][c][0] if depth > 1 else None])
        return np.array(up)

    def after(self, state: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 probability of each word (by its place in ``words``, or ``OTHER``) after a given state."""
        flat = [(d, c) for d, own in enumerate(self.contexts) for c in own.tolist()]

        def p(s: int, i: int) -> float:
            if s == 0:
                return self.unseen if i == OTHER else (self.words.count[i] - self.discount) / self.tokens
            depth, c = flat[s - 1]
            _, total, kinds = self._collected[depth][0][c]
            n = 0 if i == OTHER else self._collected[depth][1].get((c, int(self.words.hash[i])), 0)
            return (n + kinds * p(int(self.parent[s]), i)) / (total + kinds)

        return np.log10([p(int(s), int(i)) for s, i in zip(state, ids)])


@dataclass
class Words:
    """The tokens, most frequent first."""

    hash: np.ndarray
    count: np.ndarray


def grow(windows: DataFrame, known: DataFrame, positions: int, buckets: int) -> list[DataFrame]:
    """The contexts that the tests keep, by depth and bucket, from distinct windows as rows."""
    some, differ = [], []
    for depth in range(1, DEPTH + 1):
        own, up = F.col(f"c{depth}"), F.col(f"c{depth - 1}") if depth > 1 else F.lit(0).cast("long")
        counts = windows.where(F.col("depth") >= depth).groupBy(
            own.alias("context"), up.alias("suffix"), F.col("c1").alias("last"), "next").agg(F.sum("n").alias("n"))
        counts = stage(counts, "tree-counts")
        totals = counts.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where(
            F.col("total") >= LEAST_COUNT)
        some.append(stage(counts.join(totals, "context"), "tree-contexts"))
        drop(counts)
        if depth == 1:
            parent, on = known.select(F.col("hash").alias("next"), (F.col("c") / positions).alias("share")), ["next"]
        else:
            # A context's suffix occurs at least as often, so it is there.
            parent = some[-2].select(F.col("context").alias("suffix"), "next", (F.col("n") / F.col("total")).alias("share"))
            on = ["suffix", "next"]
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("share")))
        differ.append(stage(some[-1].join(parent, on).groupBy("context").agg(gain.alias("gain")).where(
            F.col("gain") >= DIVERGENCE).select("context"), "tree-differ"))
    drop(windows)
    out, wanted = [], None
    bucket = F.expr(f"shiftrightunsigned(last, 1) % {buckets}").alias("bucket")
    for depth in range(DEPTH, 0, -1):  # a kept context's suffixes are kept
        kept = differ[depth - 1]
        if wanted is not None:
            kept = kept.unionAll(wanted).distinct()
        own = stage(some[depth - 1].join(kept, "context", "left_semi"), "tree-kept-rows")
        wanted = stage(own.select(F.col("suffix").alias("context")).distinct(), "tree-wanted")
        out.append(stage(own.select(bucket, F.lit(depth).alias("depth"), "context", "suffix", "total", "next", "n").groupBy(
            "bucket").applyInArrow(_kept_rows, _BLOBS), "tree-kept"))
        drop(some[depth - 1], own)
    return out


def _groups(counts: dict[int, int], most: int) -> list[list[int]]:
    """Words in groups of about ``most`` occurrences (or one word), which are counted one after the other."""
    groups, size = [], most + 1
    for word, n in sorted(counts.items()):
        if size + n > most:
            groups.append([])
            size = 0
        groups[-1].append(word)
        size += n
    return groups


def fit(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs``, and the counts (hash, c) of their words."""
    coded, terms, parts = _counted(docs.select(F.lit(0).alias("key"), F.col(text).alias("text")), None)
    seen = stage(terms.where("chunk IS NULL").select("words", "n").mapInArrow(_known_rows, "hash long, c long"), "tree-known")
    drop(terms)
    c = F.col("c")
    total = seen.agg(F.sum(c), F.count(F.lit(1)), F.count_if(c == 1), F.count_if(c == 2),
                     F.collect_list(F.when(c > min(BUCKET, HOT), F.struct("hash", "c")))).first()
    n, types, once, twice, frequent = (total[0] or 0), total[1], total[2], total[3], total[4]
    hot = {r.hash: r.c for r in frequent if r.c > HOT}
    discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
    buckets = max(1, -(-n // BUCKET))
    spread = Counter()
    for r in frequent:
        spread[int(_share(_after(np.array([r.hash], np.int64)), buckets)[0])] += r.c
    spread = {b: 1 + c // BUCKET for b, c in spread.items()}
    tree = [stage(coded.mapInArrow(_positions(parts, buckets, k, list(hot)), _BLOBS).groupBy("bucket").applyInArrow(
        lambda t: _grow_bucket(t, n), _BLOBS), "tree-kept") for k in range(min(PASSES, buckets))]
    for some in _groups(hot, n // PASSES):
        windows = coded.mapInArrow(_hot_windows(parts, some), _WINDOWS).groupBy(*CONTEXTS, "next", "depth").agg(F.sum("n").alias("n"))
        tree += grow(stage(windows, "tree-windows"), seen, n, buckets)
    drop(coded)
    tree = reduce(DataFrame.unionAll, tree)
    states = [tree.where(F.col("depth") == d).mapInArrow(_state_rows, "context long, suffix long, total long, kinds long")
              for d in range(1, DEPTH + 1)]
    counts = [tree.where(F.col("depth") == d).mapInArrow(_count_rows, "context long, next long, n long") for d in range(1, DEPTH + 1)]
    return Model(n, types, discount, seen, states, counts, tree, buckets, spread), seen


def _bases(parts: int, model: tuple[int, int, float, float], kind: str):
    """Each text's tokens, known ones and base score, by chunk, and its score after words that are no contexts."""
    total, types, discount, unseen = model
    floor = total + 0.5 * (types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, r in enumerate(batch.to_pylist()):
                chunk = _Chunk.read(r, parts)
                starts, c = np.cumsum(chunk.lengths) - chunk.lengths, chunk.counts
                known = np.add.reduceat((c > 0)[chunk.ids].astype(np.int64), starts)
                base = np.add.reduceat(np.log10((c + 0.5) / floor)[chunk.ids], starts)
                log = np.log10(_root(c, total, discount, unseen))
                alone = np.add.reduceat(np.where(c[chunk.before()[0]] < LEAST_COUNT, log[chunk.ids], 0.0), starts)
                columns = [pa.array([r["chunk"]]), batch.column("keys").slice(k, 1), *(pa.array([b], pa.binary()) for b in (
                    _pack(chunk.lengths), _pack(known), base.tobytes(), alone.tobytes()))]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "keys", "lengths", "known", "base", "alone"])
    return run, f"chunk long, keys array<{kind}>, lengths binary, known binary, base binary, alone binary"


def _root(count: np.ndarray, total: int, discount: float, unseen: float) -> np.ndarray:
    """The root's probability of words of given counts."""
    return np.where(count > 0, (count - discount) / max(total, 1), unseen)


class _Part:
    """States and counts of one row of ``_BLOBS``, to be looked up."""

    def __init__(self, r: dict):
        self.words, self.contexts = _raw(r["words"]), _raw(r["b0"])
        self.total, self.kinds = _unpack(r["b2"]), _unpack(r["b3"])
        self.n = _unpack(r["b5"])
        self.keys = np.repeat(np.arange(len(self.kinds)), self.kinds) * len(self.words) + _unpack(r["b4"])

    def after(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """How often each word (by its place here, or -1) follows a state."""
        at = _find(self.keys, np.where(token < 0, -1, state * len(self.words) + token))
        return np.where(at < 0, 0, self.n[at])


def _scored(total: int, discount: float, unseen: float):
    """The sums of the log10 probabilities, by bucket, chunk and text, from a bucket's states and then its positions."""
    def positions(r: dict, parts: dict[int, list[_Part]]) -> tuple:
        word, count = _raw(r["words"]), _unpack(r["b0"])
        before, following = [_unpack(b) - 1 for b in _split(r["b1"])], _unpack(r["b2"])
        row = np.cumsum(_unpack(r["b3"]))
        p = _root(count, total, discount, unseen)[following]
        at, context = np.arange(len(p)), np.zeros(0, np.int64)
        for depth in range(1, DEPTH + 1):
            if depth > 1:
                some = before[depth - 1][at] >= 0
                at = at[some]
                context = _longer(context[some], word[before[depth - 1][at]], depth)
            else:
                context = _after(word)[before[0]]
            kept = np.zeros(len(at), bool)
            for part in parts.get(depth, []):
                if depth == 1:
                    state = _find(part.contexts, _after(word))[before[0]]
                else:
                    state = _find(part.contexts, context)
                here = np.flatnonzero(state >= 0)
                state, place = state[here], at[here]
                token = _find(part.words, word)[following[place]]
                kinds = part.kinds[state]
                p[place] = (part.after(state, token) + kinds * p[place]) / (part.total[state] + kinds)
                kept[here] = True
            at, context = at[kept], context[kept]  # a kept context's suffixes are kept
        first = np.flatnonzero(np.diff(row, prepend=-1))
        return r["bucket"], r["chunk"], _pack(np.diff(row[first], prepend=0)), np.add.reduceat(np.log10(p), first).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["bucket"], r["task"]) != bucket:
                    bucket, parts = (r["bucket"], r["task"]), {}
                if r["depth"] <= DEPTH:
                    parts.setdefault(r["depth"], []).append(_Part(r))
                else:
                    out.append(positions(r, parts))
            yield _rows({k: (t, [o[i] for o in out]) for i, (k, t) in enumerate(
                [("bucket", pa.int64()), ("chunk", pa.int64()), ("rows", pa.binary()), ("sums", pa.binary())])})
    return run


def _texts(key: str, kind: str, train: int):
    """A row for each text of a chunk, from its base scores and the sums of all buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, r in enumerate(batch.to_pylist()):
                n = _unpack(r["lengths"])
                score = _raw(r["alone"], np.float64).copy()
                for s in r["sums"] or []:
                    score[np.cumsum(_unpack(s["rows"]))] += _raw(s["sums"], np.float64)
                columns = [batch.column("keys").slice(k, 1).flatten(), *(pa.array(c) for c in (
                    n, _unpack(r["known"]), np.full(len(n), train, np.int64), _raw(r["base"], np.float64), score))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run, f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, seen: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: key, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are an end alone. Repeated rows are scored each. With a model of no texts
    every token is the unseen word.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    coded, terms, parts = _counted(docs, seen)
    drop(terms)
    base = stage(coded.mapInArrow(*_bases(parts, (model.tokens, model.types, model.discount, model.unseen), kind)), "tree-bases")
    tasks = F.lit(1)
    if model.spread:
        tasks = F.coalesce(F.create_map(*(F.lit(x) for pair in model.spread.items() for x in pair))[F.col("bucket").cast("int")], tasks)
    sums = []
    for k in range(min(PASSES, model.buckets)):
        part = model.tree.where(F.col("bucket") % PASSES == k).withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1)))
        asked = coded.mapInArrow(_positions(parts, model.buckets, k, []), _BLOBS)
        dealt = part.unionAll(asked.withColumn("task", F.pmod(F.hash("chunk"), tasks)))
        dealt = dealt.repartition("bucket", "task").sortWithinPartitions("bucket", "task", "depth", "chunk")
        sums.append(stage(dealt.mapInArrow(_scored(model.tokens, model.discount, model.unseen),
                                           "bucket long, chunk long, rows binary, sums binary"), "tree-sums"))
    drop(coded)
    sums = reduce(DataFrame.unionAll, sums).groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "rows", "sums"))).alias("sums"))
    return base.join(sums, "chunk", "left").mapInArrow(*_texts(key, kind, model.tokens))
