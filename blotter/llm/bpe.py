"""Byte-level BPE by speculation: propose tokens greedily, verify neighbours, merge only what fails.

A text is cut into words by the tokenizer file's own pre-tokenizer. Of the distinct words of a batch:

1. **Speculate.** From a word's first byte on, always take the longest token that fits. A walk over the
   tokens' trie finds the longest token at every byte of all words at once.
2. **Verify.** Merges run by rank, leftmost first. A proposal is what they give exactly if every token is
   what they make of its own bytes, and no two neighbours would have been merged across their border. The
   first merge across any border happens while the tokens on either side are as they would be alone, so
   each pair of neighbours can be tested by itself: going back in time, the symbols at the border are
   the last part of the left token and the first part of the right one, each alive between the rank that made
   it and the rank that used it up; a merge of both that falls into their common life breaks the
   pair. All distinct new pairs of a batch walk back together in numpy; verdicts are kept by the worker.
3. **Merge exactly.** Words with a pair that fails are merged by rank from their bytes.

Special strings of the file (such as an end of text) are cut out first and become their own ids. Decoding
gathers the bytes of all ids in numpy; bytes that are no UTF-8 become U+FFFD, as in the library.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import _PLAIN as PLAIN
from .encoding import FastEncoder
from .textbytes import CHUNK_BYTES, binary_rows, chunks

NEVER = np.int64(1) << 62
#: Verdicts on pairs (9 bytes each) and ids of units (some 36 bytes each) kept by a worker; dropped whole when full, which
#: costs time only.
KEPT_PAIRS, KEPT_UNITS = 1_000_000, 400_000
#: Words of up to so many bytes are merged together, longer ones each alone.
SHORT = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level file: printable bytes stand for themselves, the rest follow 0xFF."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, more = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(more)
            more += 1
    return [letters[b] for b in range(256)]


class Merges:
    """The tokens of a byte-level file as arrays: bytes, parts, ranks, trie, and verdicts on pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = model["vocab"]
        self.special = {a["content"]: a["id"] for a in file.get("added_tokens", [])}
        size = max([*vocabulary.values(), *self.special.values()], default=-1) + 1
        self.bytes = [b""] * size
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(self.byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.single = np.full(256, -1, np.int64)
        for c, b in self.byte_of.items():
            self.single[b] = vocabulary.get(c, -1)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key)
        # The last entry is a sentinel, so that a look-up never falls off.
        self.merge_key = np.concatenate((key[order], [NEVER]))
        self.merge_rank = np.concatenate((order.astype(np.int64), [NEVER]))
        self.made = made
        self.merge_of = dict(zip(key.tolist(), zip(range(len(made)), made.tolist())))

        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.left[made], self.right[made], self.rank[made] = left, right, np.arange(len(made))
        # A token that several merges make has no parts of its own; it is never proposed.
        several = np.bincount(made, minlength=size) > 1
        self.sound = (np.isin(np.arange(size), self.single) | (self.rank >= 0)) & ~several
        built = np.flatnonzero(self.sound & (self.rank >= 0))
        self.sound[built] = self._apart(self.left[built], self.right[built], self.rank[built])
        while True:  # a token is sound only if its parts are
            whole = self.sound[built] & self.sound[self.left[built]] & self.sound[self.right[built]]
            if (whole == self.sound[built]).all():
                break
            self.sound[built] = whole
        self._trie()
        self.pair_key, self.pair_good = np.zeros(0, np.int64), np.zeros(0, bool)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.begin = np.cumsum(self.length) - self.length

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two tokens, ``NEVER`` where there is none."""
        key = a << 32 | b
        at = np.searchsorted(self.merge_key, key)
        return np.where(self.merge_key[at] == key, self.merge_rank[at], NEVER)

    def _apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge joins the border of tokens a and b before the rank ``until``.

        ``a_end`` and ``b_end`` are the ranks that use up the symbols now at the border. Equal ranks: the
        merge further left comes first, so one inside the left token beats one across the border, and the
        latter beats one inside the right token.
        """
        good = np.ones(len(a), bool)
        todo = np.arange(len(a))
        a_end = np.full(len(a), NEVER) if until is None else until.copy()
        b_end = a_end.copy()
        a, b = a.copy(), b.copy()
        while len(todo):
            m = self._rank_of(a, b)
            joined = (m < a_end) & (m <= b_end)
            good[todo[joined]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~joined & ((ra >= 0) | (rb >= 0))
            todo, a, b, a_end, b_end, ra, rb = (x[go] for x in (todo, a, b, a_end, b_end, ra, rb))
            back_a = ra > rb  # the symbol made last is taken apart first
            a_end, b_end = np.where(back_a, ra, a_end), np.where(back_a, b_end, rb)
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
        return good

    def _trie(self) -> None:
        """Edges (node, byte) -> node, sorted, and the token that ends at each node."""
        nodes: dict[int, int] = {}
        ends = [-1]
        for i in np.flatnonzero(self.sound).tolist():
            at = 0
            for byte in self.bytes[i]:
                edge = at << 8 | byte
                at = nodes.get(edge, 0)
                if not at:
                    at = nodes[edge] = len(ends)
                    ends.append(-1)
            ends[at] = i
        edge = np.array(list(nodes), np.int64)
        order = np.argsort(edge)
        self.edge = np.concatenate((edge[order], [NEVER]))
        self.node = np.concatenate((np.array(list(nodes.values()), np.int64)[order], [0]))
        self.ends = np.array(ends, np.int64)

    def longest(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token, length) of the longest sound token at each byte, within ``room`` bytes from there."""
        n = len(data)
        token, size = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        place, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(place):
            edge = node << 8 | data[place + depth]
            at = np.searchsorted(self.edge, edge)
            found = self.edge[at] == edge
            place, node = place[found], self.node[at[found]]
            depth += 1
            ends = self.ends[node]
            here = ends >= 0
            token[place[here]], size[place[here]] = ends[here], depth
            more = room[place] > depth
            place, node = place[more], node[more]
        return token, size

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b stay apart when they stand side by side."""
        key, back = np.unique(a << 32 | b, return_inverse=True)
        at = np.searchsorted(self.pair_key, key)
        known = np.zeros(len(key), bool)
        if len(self.pair_key):
            known = self.pair_key[np.minimum(at, len(self.pair_key) - 1)] == key
        good = np.zeros(len(key), bool)
        good[known] = self.pair_good[at[known]]
        new = key[~known]
        if len(new):
            good[~known] = self._apart(new >> 32, new & 0xFFFFFFFF)
            if len(self.pair_key) + len(new) > KEPT_PAIRS:
                self.pair_key, self.pair_good = key, good
            else:
                self.pair_key = np.insert(self.pair_key, at[~known], new)
                self.pair_good = np.insert(self.pair_good, at[~known], good[~known])
        return good[back]

    def merge(self, word: bytes) -> list[int]:
        """The tokens of one word by its merges: least rank first, then leftmost."""
        token = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(token)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.merge_of.get(token[i] << 32 | token[j])):
                heapq.heappush(waiting, (found[0], i, token[i], token[j]))

        for i in range(n):
            offer(i)
        while waiting:
            rank, i, a, b = heapq.heappop(waiting)
            j = after[i] if token[i] == a else n
            if j >= n or token[j] != b:
                continue  # one of both has been used up
            token[i], token[j], after[i] = self.merge_of[a << 32 | b][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [t for t in token if t >= 0]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of each word. Words of up to ``SHORT`` bytes take their next merge together, one a round."""
        out: list[list[int]] = [self.merge(w) if len(w) > SHORT else [] for w in words]
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        token = self.single[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        owner = np.repeat(np.arange(len(short)), [len(words[i]) for i in short])
        done_token, done_owner = [token[:0]], [owner[:0]]
        while len(token):
            rank = np.full(len(token), NEVER)
            rank[:-1] = np.where(owner[1:] == owner[:-1], self._rank_of(token[:-1], token[1:]), NEVER)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.concatenate((first, [len(token)]))))
            ended = least == NEVER
            done_token.append(token[ended])
            done_owner.append(owner[ended])
            at = np.flatnonzero((rank == least) & ~ended)
            at = at[np.unique(owner[at], return_index=True)[1]]  # the leftmost of each word
            token = token.copy()
            token[at] = self.made[rank[at]]
            keep = ~ended
            keep[at + 1] = False
            token, owner = token[keep], owner[keep]
        token, owner = np.concatenate(done_token), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(short))).tolist()
        flat, begin = token[order].tolist(), 0
        for i, end in zip(short, ends):
            out[i], begin = flat[begin:end], end
        return out

    def words(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each word; words are not empty and are merged each alone."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(size)
        token, step = self.longest(data, np.repeat(ends, size) - np.arange(len(data)))
        taken = np.zeros(len(data), bool)
        at, end = ends - size, ends
        broken = np.zeros(len(words), bool)
        which = np.arange(len(words))
        while len(at) > 64:  # all words take their next token together
            taken[at] = True
            stuck = step[at] == 0
            broken[which[stuck]] = True
            at = at + step[at]
            go = ~stuck & (at < end)
            at, end, which = at[go], end[go], which[go]
        hop = step.tolist() if len(at) else []
        for a, z, w in zip(at.tolist(), end.tolist(), which.tolist()):  # the few long ones
            path = []
            while a < z and hop[a]:
                path.append(a)
                a += hop[a]
            broken[w] |= a < z
            taken[path] = True
        place = np.flatnonzero(taken)
        owner = np.searchsorted(ends, place, side="right")
        proposed = token[place]
        beside = np.flatnonzero(owner[1:] == owner[:-1])
        beside = beside[~broken[owner[beside]]]
        good = self.compatible(proposed[beside], proposed[beside + 1])
        broken[owner[beside[~good]]] = True
        counts = np.bincount(owner, minlength=len(words))
        split = np.concatenate(([0], np.cumsum(counts))).tolist()
        flat = proposed.tolist()
        merged = iter(self.merge_all([words[i] for i in np.flatnonzero(broken)]))
        return [next(merged) if b else flat[split[i]:split[i + 1]] for i, b in enumerate(broken.tolist())]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows one after the other, how many each row has); ids without a token give none."""
        ids = ids.astype(np.int64)
        inside = (ids >= 0) & (ids < len(self.length))
        size = np.where(inside, self.length[np.where(inside, ids, 0)], 0)
        ends = np.cumsum(size)
        begin = self.begin[np.where(inside, ids, 0)]
        index = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - begin, size)
        row_ends = np.concatenate(([0], ends))[np.cumsum(counts)]
        return self.flat[index], np.diff(np.concatenate(([0], row_ends)))


class SpeculativeEncoder(FastEncoder):
    """Texts to ids by ``Merges``: the tokenizer file's library gives the cuts between words only."""

    def __init__(self, path: str):
        super().__init__(path)
        self.merges = merges_of(path)
        self.cache_units = KEPT_UNITS
        self.plain = {ord(c): b for c, b in self.merges.byte_of.items()}

    def _words_of(self, text: str) -> list[bytes]:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [word.translate(self.plain).encode("latin-1") for word, _ in cut]

    def _encode_units(self, units: list[bytes]) -> list[list[int]]:
        split = []
        for unit in units:  # most are letters, perhaps followed by punctuation: surely one or two words
            m = PLAIN.match(unit)
            split.append([w for w in m.groups() if w] if m else self._words_of(unit.decode()))
        distinct = list(dict.fromkeys(w for words in split for w in words))
        if not distinct:
            return [[] for _ in units]
        ids = dict(zip(distinct, self.merges.words(distinct)))
        return [[i for w in words for i in ids[w]] for words in split]

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        if not hasattr(self, "merges"):  # while the file is being read
            return super()._direct(texts)
        return [np.array(x, np.uint32) for x in self._encode_units([t.encode() for t in texts])]

    def encode_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, how many each row has); special strings are their own ids, null is an empty text."""
        texts = None
        for special in self.merges.special:
            if pc.any(pc.match_substring(column, special)).as_py():
                texts = texts or column.to_pylist()
        if texts is None:
            return self.encode_rows(column)
        parts, owner, fixed = [], [], []
        for row, text in enumerate(texts):
            for piece in _cut(text or "", self.merges.special):
                owner.append(row)
                fixed.append(self.merges.special.get(piece, -1))
                parts.append("" if fixed[-1] >= 0 else piece)
        ids, counts = self.encode_rows(pa.array(parts, pa.large_string()))
        fixed, owner = np.array(fixed, np.int64), np.array(owner, np.int64)
        ids = np.insert(ids, np.cumsum(counts)[fixed >= 0], fixed[fixed >= 0].astype(np.uint32))
        return ids, np.bincount(owner, weights=counts + (fixed >= 0), minlength=len(texts)).astype(np.int64)


def _cut(text: str, special: dict[str, int]) -> list[str]:
    """The text in pieces: special strings, the leftmost first, and what lies between."""
    out, at = [], 0
    while found := min(((text.find(s, at), -len(s), s) for s in special if s in text[at:]), default=None):
        out += [text[at:found[0]], found[2]]
        at = found[0] + len(found[2])
    return [*out, text[at:]]


_merges: dict[str, Merges] = {}
_encoders: dict[str, SpeculativeEncoder] = {}


def merges_of(path: str) -> Merges:
    """The worker's tokens of a tokenizer file, made once; enough for decoding."""
    if path not in _merges:
        _merges[path] = Merges(path)
    return _merges[path]


def encoder(path: str) -> SpeculativeEncoder:
    """The worker's encoder for a tokenizer file, made once."""
    if path not in _encoders:
        _encoders[path] = SpeculativeEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """``docs`` without its text, with the ids (binary, little-endian unsigned 32-bit) and their number.

    Null and empty texts have no ids; a very long text is encoded whole. Every row is encoded by itself, so
    repeated rows, ties and null keys stay as they are. Input columns named as the new ones are replaced;
    an empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c not in (text, ids, count)]
    slim = docs.select(*rest, F.col(text).alias("__text"))
    fields = ", ".join(f"`{c.replace('`', '``')}` {slim.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for a, b in chunks(batch, "__text"):
                part = batch.slice(a, b - a)
                flat, counts = enc.encode_texts(part.column("__text"))
                columns = [*(part.column(c) for c in rest), binary_rows(flat.astype("<u4"), counts), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=[*rest, ids, count])

    return slim.mapInArrow(run, f"{fields + ', ' if fields else ''}`{ids}` binary, `{count}` long")


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text of their ids (binary, as ``encode`` gives them); special ids give their strings.

    Null ids give the empty text, ids that the file does not have give nothing. An input column named as
    ``text`` is replaced.
    """
    rest = [c for c in rows.columns if c != text]
    slim = rows.select(*rest)
    fields = ", ".join(f"`{c.replace('`', '``')}` {slim.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(path)
        for batch in batches:
            for a, b in _ranges(batch.column(ids)):
                part = batch.slice(a, b - a)
                raw = [x or b"" for x in part.column(ids).to_pylist()]
                counts = np.array([len(x) // 4 for x in raw], np.int64)
                flat = np.frombuffer(b"".join(x[:len(x) // 4 * 4] for x in raw), "<u4")
                data, sizes = merges.decode(flat, counts)
                whole, ends = data.tobytes(), np.cumsum(sizes).tolist()
                texts = [whole[z - n:z].decode("utf-8", "replace") for z, n in zip(ends, sizes.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*rest, text])

    return slim.mapInArrow(run, f"{fields}, `{text}` string")


def _ranges(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of ids each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
