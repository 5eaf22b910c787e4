"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, one occurrence for each group.

Lines end at line feeds. A line counts by its words (runs without ASCII white space, ASCII letters
lower-cased) joined by single spaces. Lines without words are never touched.

1. Lines of the same words are one node (by a 128-bit fingerprint), with a SimHash of ``64 * HASH_WORDS`` bits over its
   distinct runs of ``GRAM`` bytes.
2. Pigeonhole blocks: two lines are candidates if one of their ``BLOCKS`` blocks of ``BLOCK_BITS`` bits is equal and their
   lengths lie in one class. Classes double; a line that may have partners in the next class is in both.
   Lines within ``BLOCKS`` - 1 bits over the blocks share one for certain, most lines of a few times that do.
3. A bucket's lines are kept if another line of it, of a length that the edit similarity allows, lies within ``HALF_NEAR`` of half of the bits, then within ``NEAR`` of all
   (see ``_mates``): this drops what shares a block by chance before anything is paired. Blocks are taken in ``PASSES`` passes.
4. Pairs in a bucket within ``NEAR`` and of near lengths are confirmed by edit similarity, in percent of the longer line's
   characters: at least ``PERCENT``. Components of confirmed pairs are groups (see ``linking``: no bucket is paired out).
5. The occurrence of the least (key, line number) of each group stays; all others are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import link
from .simhash import simhashes
from .store import drop, stage
from .textbytes import Spans, binary_rows, chunks, lower, mix, row_bytes, span_hashes, words

PERCENT = 85
#: Pairs, and their characters, whose edit distances are found at once; pairs of longer lines are taken alone.
PAIRS_AT_ONCE, CHARS_AT_ONCE, LONG_CHARS = 1024, 1 << 19, 2048
#: Edits that are tried before the bound of each pair itself, and steps after which counted edits are cut to the bound.
BOUNDS, STEPS = (40, 100, 188), 64
#: Characters of texts that are compared at once, of a piece of a long pair, and of what both have where it is cut.
HOLD_CHARS, PIECE, ANCHOR = 1 << 23, 192, 12
#: The SimHash: bytes of a run, 64-bit words, blocks and their bits, and the share of differing bits up to which lines are near.
GRAM, HASH_WORDS, BLOCKS, BLOCK_BITS, NEAR = 4, 4, 16, 16, 0.25
#: The same for half of the SimHash, which differs by chance a little more or less than the whole.
HALF_NEAR = 0.28
#: Lines of fewer characters are near no other line: one edit is too much.
LEAST_CHARS = -(-100 // (100 - PERCENT))
#: Passes over the blocks, lines and rows that a task deals and receives at once, and bits of the sieve for the near lines' words.
PASSES, DEAL_ROWS, RANGE_ROWS, SIEVE_BITS = 4, 1 << 16, 1 << 14, 1 << 26
HASH = [f"s{i}" for i in range(HASH_WORDS)]


def line_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Spans, np.ndarray, np.ndarray]:
    """(words, line of each word, first byte of each line); lines are numbered over all rows."""
    feeds = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    spans = words(data, offsets)
    # A row's first line begins at its offset; empty rows share that place with the next row's.
    places = np.concatenate((np.searchsorted(spans.start, begin), [len(spans.start)]))
    return spans, np.repeat(np.arange(len(begin)), np.diff(places)), begin


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, 128-bit fingerprint) of every line that has words."""
    return _prints(*row_bytes(column))[:3]


def _prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Spans, np.ndarray]:
    """What ``fingerprints`` gives, and the words and the line of each."""
    spans, line, begin = line_words(data, offsets)
    n = len(line)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros((0, 2), np.uint64), spans, line
    h = span_hashes(Spans(lower(data), spans.start, spans.end, spans.row))
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    size = np.diff(np.concatenate((first, [n])))
    place = (np.arange(n) - np.repeat(first, size)).astype(np.uint64)
    prints = np.stack([np.add.reduceat(mix(h + mix(place + np.uint64(c))), first) for c in (1, 1 << 40)], axis=1)
    row = spans.row[first]
    return row, line[first] - np.searchsorted(begin, offsets[row], side="right") + 1, prints, spans, line


def normalised(data: np.ndarray, spans: Spans, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, end) of the lines that have words: each its words, lower-cased, joined by single spaces."""
    if not len(line):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), z, z
    size = spans.end - spans.start + 1  # with the space behind
    ends = np.cumsum(size)
    index = np.arange(ends[-1]) + np.repeat(spans.start - (ends - size), size)
    out = np.concatenate((lower(data), np.zeros(1, np.uint8)))[index]
    out[ends - 1] = 0x20
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    return out, (ends - size)[first], ends[np.concatenate((first[1:], [len(line)])) - 1] - 1


def _words_of(some: np.ndarray, spans: Spans, line: np.ndarray) -> tuple[Spans, np.ndarray]:
    """The words, and their lines, of some of the lines that have words."""
    first = np.flatnonzero(np.concatenate((np.ones(min(len(line), 1), bool), line[1:] != line[:-1])))
    size = np.diff(np.concatenate((first, [len(line)])))[some]
    at = np.arange(size.sum()) + np.repeat(first[some] - (np.cumsum(size) - size), size)
    return Spans(spans.data, spans.start[at], spans.end[at], spans.row[at]), line[at]


_LINES = "key long, line int, high long, low long, chars int, " + ", ".join(f"{c} long" for c in HASH)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch):
            part = batch.slice(a, b - a)
            data, offsets = row_bytes(part.column("text"))
            row, line, prints, *parts = _prints(data, offsets)
            text, begin, end = normalised(data, *parts)
            inner = np.flatnonzero((text & 0xC0) == 0x80)  # bytes that begin no character
            chars = end - begin - (np.searchsorted(inner, end) - np.searchsorted(inner, begin))
            hashes = simhashes(text, begin, end, GRAM, HASH_WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(row)), pa.array(line, pa.int32()), pa.array(prints[:, 0].astype(np.int64)),
                 pa.array(prints[:, 1].astype(np.int64)), pa.array(chars, pa.int32()),
                 *(pa.array(hashes[:, w]) for w in range(HASH_WORDS))],
                names=["key", "line", "high", "low", "chars", *HASH])


def _sieve(prints: DataFrame, rows: int) -> np.ndarray:
    """Bits set at both halves of the fingerprints (high, low): of other fingerprints some 1.4 percent have both set.

    It takes 16 bits a fingerprint, at most ``SIEVE_BITS``; beyond that it only lets more pass.
    """
    bits = min(1 << max(16 * rows, 64).bit_length(), SIEVE_BITS)
    at = F.explode(F.array(*(F.col(c).bitwiseAND(bits - 1) for c in ("high", "low"))))
    words = prints.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).toArrow()
    sieve = np.zeros(bits // 64, np.uint64)
    sieve[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return sieve


def _passing(sieve: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = prints & np.uint64(64 * len(sieve) - 1)
    return (sieve[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1)


def _line_texts(sieve: Broadcast):
    """(high, low, words): the lines that pass, once for each chunk, as their words joined by single spaces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch):
                data, offsets = row_bytes(batch.column("text").slice(a, b - a))
                _, _, prints, spans, line = _prints(data, offsets)
                some = np.flatnonzero(_passing(sieve.value, prints)) if len(prints) else np.zeros(0, np.int64)
                some = np.sort(some[np.unique(prints[some, 0], return_index=True)[1]])
                text, begin, end = normalised(data, *_words_of(some, spans, line))
                out = [text[x:y].tobytes().decode() for x, y in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(prints[some, c].view(np.int64)) for c in (0, 1)), pa.array(out, pa.string())],
                    names=["high", "low", "words"])
    return run


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance: common ends cut off, then bit-parallel over one long integer.

    With ``most``, work ends once the distance is sure to be greater, and some greater number is returned.
    """
    a, b = _trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    ones, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, distance = ones, 0, len(a)  # between neighbouring cells of a column
    left = len(b) + (len(a) + len(b) if most is None else most)  # each character left takes off one at most
    for c in b:
        if distance > left:
            break
        left -= 1
        match = places.get(c, 0)
        diagonal = ((((match & rises) + rises) ^ rises) | match | falls) & ones
        up, down = falls | (ones & ~(diagonal | rises)), rises & diagonal
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & ones, (down << 1) & ones
        rises, falls = down | (ones & ~(diagonal | up)), up & diagonal
    return distance


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without their common ends, the shorter first."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # length of the common prefix
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:  # and of the common suffix
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[-middle:] == b[-middle:] else (low, middle - 1)
    a, b = a[:len(a) - low], b[:len(b) - low]
    return (a, b) if len(a) <= len(b) else (b, a)


def _most_edits(a: str, b: str, most: int) -> int:
    """At least the edit distance, and mostly that: the texts are cut where both have the same characters, and the pieces' distances added."""
    edits, i, j, to = 0, 0, 0, PIECE
    while i + to + ANCHOR < len(a) and edits <= most:
        at = b.find(a[i + to:i + to + ANCHOR], max(j, j + to - PIECE // 2), j + to + PIECE // 2)
        if at < 0:
            to += ANCHOR
            continue
        edits += edit_distance(a[i:i + to], b[j:at])
        i, j, to = i + to, at, PIECE
    return edits + (edit_distance(a[i:], b[j:]) if edits <= most else 0)


def _columns(texts: list[str], before: int, rows: int, pad: int, back: bool, narrow: bool) -> np.ndarray:
    """Code points (``narrow``: bytes of ASCII), a text in each column from row ``before`` on, ``pad`` around; ``back``: last character
    first, up to the same row."""
    kind, coding = (np.uint8, "ascii") if narrow else (np.int32, "utf-32-le")
    out = np.full((len(texts), rows), pad, kind)
    for own, text in zip(out, texts):
        codes = np.frombuffer(text.encode(coding, "surrogatepass"), kind)
        if back:
            own[rows - before - len(codes):rows - before] = codes[::-1]
        else:
            own[before:before + len(codes)] = codes
    return np.ascontiguousarray(out.T)


def _close(one: list[str], two: list[str], most: np.ndarray) -> np.ndarray:
    """Which pairs are at most so many edits apart: all of them at once, by the diagonals within the greatest of the bounds.

    Anti-diagonal s of the table has the cells i + j = s; a cell's place is that of its diagonal j - i, every second one.
    A step adds one edit at most, so cells that are cut to the greatest bound and one every ``STEPS`` steps stay small.
    """
    bound = int(most.max())
    wide = bound + bound % 2  # diagonals -wide to wide
    n, m = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    last, place = n + m, (m - n + wide) >> 1
    half, steps, limit = wide // 2, int(last.max()), most
    rows = int(max(n.max(), m.max())) + wide + 2  # places of characters that a step may ask for
    narrow = all(map(str.isascii, one)) and all(map(str.isascii, two))
    pads = (254, 255) if narrow else (-1, -2)
    a, b = _columns(one, half, rows, pads[0], True, narrow), _columns(two, half, rows, pads[1], False, narrow)
    kind = np.uint8 if bound + 1 + STEPS < 255 else np.uint16
    far, step = kind(bound + 1), kind(1)
    even, odd = np.full((wide + 1, len(one)), far), np.full((wide + 2, len(one)), far)
    even[half] = 0
    out = np.where(last == 0, 0, bound + 1)
    own = np.argsort(last, kind="stable")  # the pairs of the columns that are left, those that end first in front
    a, b, ended = a.take(own, axis=1), b.take(own, axis=1), int((last == 0).sum())
    ends = last[own]
    differ = np.empty((wide + 1, len(one)), bool)
    for s in range(1, steps + 1):
        # Cell (i, j) compares characters i - 1 and j - 1; the first of them, of the lowest diagonal, has the greatest i.
        if s % 2:
            i, j, cells = (s + wide - 1) // 2, (s - wide + 1) // 2, wide
            near, prev = odd[1:-1], np.minimum(even[:-1], even[1:])
        else:
            i, j, cells = (s + wide) // 2, (s - wide) // 2, wide + 1
            near, prev = even, np.minimum(odd[:-1], odd[1:])
        if cells:
            top, left = rows - half - i, half + j - 1
            unlike = np.not_equal(a[top:top + cells], b[left:left + cells], out=differ[:cells])
            near += unlike.view(np.uint8)
            prev += step
            np.minimum(near, prev, out=near)
        while ended < len(own) and ends[ended] == s:
            p = own[ended]
            if abs(int(m[p]) - int(n[p])) <= wide - s % 2:
                out[p] = near[place[p] if s % 2 == 0 else (m[p] - n[p] + wide - 1) >> 1, ended]
            ended += 1
        if s % STEPS == 0:
            np.minimum(even, far, out=even)
            np.minimum(odd, far, out=odd)
            left = np.flatnonzero((np.minimum(even.min(axis=0), odd.min(axis=0)) <= limit[own]) & (np.arange(len(own)) >= ended))
            if 4 * len(left) <= 3 * len(own):  # the others have ended or are too far apart
                own, ended, ends = own[left], 0, ends[left]
                a, b, even, odd, differ = (x.take(left, axis=1) for x in (a, b, even, odd, differ))
                if not len(own):
                    break
    return out <= most


def _within(one: list[str], two: list[str], most: list[int]) -> np.ndarray:
    """Which pairs are at most ``most`` edits apart."""
    keep, left = np.zeros(len(one), bool), []
    for p, (x, y) in enumerate(zip(one, two)):
        x, y = _trimmed(x, y)
        if len(y) <= most[p]:  # at most every character of the longer one
            keep[p] = True
        elif len(y) > LONG_CHARS:
            keep[p] = len(y) - len(x) <= most[p] and (
                _most_edits(x, y, most[p]) <= most[p] or edit_distance(x, y, most[p]) <= most[p])
        elif len(y) - len(x) <= most[p]:
            left.append((not (x.isascii() and y.isascii()), len(x) + len(y), p, x, y))
    left.sort()
    for bound in (*BOUNDS, None):  # most near pairs are a few edits apart
        at, far = 0, []
        while at < len(left):  # the longest of them decides how many fit
            to = min(at + PAIRS_AT_ONCE, len(left))
            while to > at + 1 and (to - at) * left[to - 1][1] > CHARS_AT_ONCE:
                to = at + (to - at + 1) // 2
            part = left[at:to]
            limits = np.array([most[p] if bound is None or 2 * most[p] < 3 * bound else bound for *_, p, _, _ in part])
            near = _close([x for *_, x, _ in part], [y for *_, y in part], limits)
            for pair, ok, limit in zip(part, near.tolist(), limits.tolist()):
                if ok:
                    keep[pair[2]] = True
                elif limit < most[pair[2]]:
                    far.append(pair)
            at = to
        left = far
    return keep


def _similar(percent: int):
    def similar(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = ([w for batch in held for w in batch.column(c).to_pylist()] for c in ("w_a", "w_b"))
        most = [(100 - percent) * max(len(x), len(y)) // 100 for x, y in zip(one, two)]
        keep, at = pa.array(_within(one, two, most), pa.bool_()), 0
        for batch in held:
            yield batch.select(["a", "b"]).filter(keep.slice(at, batch.num_rows))
            at += batch.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HOLD_CHARS:
                yield from similar(held)
                held, size = [], 0
        if held:
            yield from similar(held)
    return run


def _deal(percent: int, blocks: range, ranges: int):
    """Rows (range, rows): the lines of each range of buckets, as six 64-bit words each: id, characters and bucket, SimHash.

    The bucket is the block and the length's class (above the characters' 32 bits) and the block's bits of the SimHash.
    """
    def deal(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, chars, *hashes = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("id", "chars", *HASH))
        hashes = np.stack(hashes, axis=1).view(np.uint64)
        size, beyond = (np.floor(np.log2(x) + 1e-9).astype(np.int64) for x in (chars, chars * 100 / percent))
        more = np.flatnonzero(beyond > size)
        line, cls = np.concatenate((np.arange(len(node)), more)), np.concatenate((size, size[more] + 1))
        each, tag = np.tile(line, len(blocks)), np.concatenate([cls * BLOCKS + b for b in blocks])
        rows = np.concatenate((node.view(np.uint64)[each, None], (tag << 32 | chars[each]).view(np.uint64)[:, None], hashes[each]), axis=1)
        to = (mix(_bucket(rows).view(np.uint64)) % np.uint64(ranges)).astype(np.uint16 if ranges <= 1 << 16 else np.int64)
        order = np.argsort(to, kind="stable")  # a radix sort for 16 bits
        own, counts = np.unique(to, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), binary_rows(rows[order], counts * rows.shape[1])], names=["range", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= DEAL_ROWS:
                yield deal(held)
                held, n = [], 0
        if n:
            yield deal(held)
    return run


def _bucket(rows: np.ndarray) -> np.ndarray:
    """The buckets of rows dealt by ``_deal``: the length's class, the block's number and its bits, in one whole number."""
    tag = (rows[:, 1] >> np.uint64(32)).astype(np.int64)
    at = tag % BLOCKS * BLOCK_BITS
    bits = rows[np.arange(len(rows)), 2 + at // 64] >> (at % 64).astype(np.uint64) & np.uint64((1 << BLOCK_BITS) - 1)
    return tag << BLOCK_BITS | bits.astype(np.int64)


def _mated(key: np.ndarray, hashes: np.ndarray, most: int, percent: int) -> np.ndarray:
    """Which lines have a line of near length beside them in their bucket that differs in at most ``most`` bits.

    Sorted by ``key``, the bucket above 32 bits of characters: a line's longer mates lie right behind it.
    """
    chars = key & 0xFFFFFFFF
    found, last = np.zeros(len(key), bool), np.searchsorted(key, key - chars + 100 * chars // percent, side="right")
    at, step = np.arange(len(key)), 1
    more, hashes = last - at, np.ascontiguousarray(hashes.T)
    while len(at := at[more[at] > step]):
        some = at[~(found[at] & found[at + step])]
        apart = np.zeros(len(some), np.uint16)
        for h in hashes:
            apart += np.bitwise_count(h[some] ^ h[some + step])
            few = apart <= most
            some, apart = some[few], apart[few]
        found[some] = found[some + step] = True
        step += 1
    return found


def _mates(percent: int):
    """Rows (bucket, id, chars, SimHash) of the lines that have, beside them in their bucket, a line of near length within
    ``HALF_NEAR`` of half of the SimHash's bits, and of these lines one within ``NEAR`` of all. Rows of ``_deal`` come sorted by range."""
    def near(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        key = _bucket(rows) << 32 | (rows[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.argsort(key)
        key, rows = key[order], rows[order]
        for words, share in ((HASH_WORDS // 2, HALF_NEAR), (HASH_WORDS, NEAR)):  # half first: it drops most
            found = _mated(key, rows[:, 2:2 + words], int(share * 64 * words), percent)
            key, rows = key[found], rows[found]
        columns = [key >> 32, rows[:, 0].astype(np.int64), (key & 0xFFFFFFFF).astype(np.int32), *(c.astype(np.int64) for c in rows[:, 2:].T)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "id", "chars", *HASH])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for own, rows in zip(batch.column("range").to_pylist(), batch.column("rows")):
                if own != now and held:
                    yield near(held)
                    held = []
                now = own
                held.append(np.frombuffer(rows.as_buffer(), np.uint64).reshape(-1, 2 + HASH_WORDS))
        if held:
            yield near(held)
    return run


_MEMBERS = "bucket long, id long, chars int, " + ", ".join(f"{c} long" for c in HASH)


def _members(nodes: DataFrame, percent: int) -> list[DataFrame]:
    """Staged tables of the lines that have mates, by some blocks each: no more than these blocks' rows are shuffled at once."""
    spark, each = nodes.sparkSession, BLOCKS // PASSES
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(tasks, nodes.count() * each // RANGE_ROWS)
    least = -(-100 // (100 - percent)) if percent < 100 else 1 << 30
    rows = nodes.where(F.col("chars") >= least).select("id", "chars", *HASH)
    out = []
    for first in range(0, BLOCKS, each):
        dealt = rows.mapInArrow(_deal(percent, range(first, first + each), ranges), "range long, rows binary")
        dealt = dealt.repartition("range").sortWithinPartitions("range")
        out.append(stage(dealt.mapInArrow(_mates(percent), _MEMBERS), "line-mates"))
    return out


def _hamming(one: str, two: str) -> Column:
    return sum((F.bit_count(F.col(f"{one}.{c}").bitwiseXOR(F.col(f"{two}.{c}"))) for c in HASH), F.lit(0))


def _may_be_near(percent: int):
    """SimHashes within the radius, and lengths that the edit similarity allows."""
    def near(one: str, two: str) -> Column:
        chars = [F.col(f"{one}.chars"), F.col(f"{two}.chars")]
        return (100 * F.least(*chars) >= percent * F.greatest(*chars)) & (_hamming(one, two) <= int(NEAR * 64 * HASH_WORDS))
    return near


def groups(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(every line, the lines' groups) of ``docs`` (key, text).

    The lines have (key, line, high, low); the groups (high, low, root, keep_key, keep_line) list
    the fingerprints of lines that occur more than once or near each other, and the occurrence to keep.
    """
    lines = stage(docs.mapInArrow(_lines, _LINES), "lines")
    nodes = lines.groupBy("high", "low").agg(
        F.min(F.struct("key", "line")).alias("first"), F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in ("chars", *HASH)))
    nodes = stage(nodes.withColumn("id", F.monotonically_increasing_id()), "line-nodes")
    parts = _members(nodes, percent)
    members = reduce(DataFrame.unionAll, parts)
    near = stage(nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "high", "low"), "line-near")
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(near, near.count()))
    texts = docs.select("text").mapInArrow(_line_texts(sieve), "high long, low long, words string").join(near, ["high", "low"])
    words_of = stage(texts.select("id", "words").dropDuplicates(["id"]), "line-words")
    drop(near)
    sieve.unpersist()

    def verify(pairs: DataFrame) -> DataFrame:
        one = words_of.select(F.col("id").alias("a"), F.col("words").alias("w_a"))
        two = words_of.select(F.col("id").alias("b"), F.col("words").alias("w_b"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "w_a", "w_b").mapInArrow(_similar(percent), "a long, b long")

    found = link(members, verify, near=_may_be_near(percent))
    drop(*parts, words_of)
    grouped = nodes.select("id", "high", "low", "first", "n").join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = grouped.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1")
    kept = grouped.select("high", "low", "root").join(several, "root").select(
        "high", "low", "root", F.col("keep.key").alias("keep_key"), F.col("keep.line").alias("keep_line"))
    kept = stage(kept, "line-groups")
    drop(nodes, found)
    return lines.select("key", "line", "high", "low"), kept


def dedup_lines(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated lines: columns as given, and removed_lines (long).

    A text keeps its other lines and their line feeds as they were; one that loses nothing is unchanged.
    Null and empty texts and lines without words are unchanged. ``key`` holds whole numbers; a null
    key comes before all others. Rows that share a key and a line number keep or lose that line alike, so
    repeated rows stay repeated. Input columns named removed_lines are replaced. An empty table gives an
    empty result.
    """
    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    lines, kept = groups(slim, percent)
    gone = lines.join(kept, ["high", "low"]).where(
        ~(F.col("key").eqNullSafe(F.col("keep_key")) & (F.col("line") == F.col("keep_line"))))
    gone = gone.select(F.col("key").alias("__key"), "line").distinct().groupBy("__key").agg(
        F.collect_list("line").alias("__gone"))  # line numbers of one document
    rows = docs.drop("removed_lines").join(gone, F.col(key).cast("long").eqNullSafe(F.col("__key")), "left")
    left = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("__gone", i))
    return rows.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))).withColumn(
        "removed_lines", F.coalesce(F.size("__gone"), F.lit(0)).cast("long")).drop("__key", "__gone")
