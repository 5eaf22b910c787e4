"""SimHashes of many byte strings at once, by bit-sliced counters.

Bit b of a string's SimHash is the majority of bit b over the hashes of its distinct n-grams. All
strings of a batch take their k-th n-gram together, all its words side by side: 64 counters of a string lie across a few words
("planes"), plane j holding bit j of all 64 counts. Words of one weight wait in pairs: a full adder puts two of them and the plane into
the plane and one word of twice the weight, so a plane is touched half as often as the one below it.
"""

from __future__ import annotations

import numpy as np

from .textbytes import mix

#: Strings of more n-grams are counted by pieces of so many; n-grams counted at once.
LONG, AT_ONCE = 1024, 1 << 20
#: Repeats: n-grams looked up at once, slots for each, and lookups by another hash before the rest is sorted. Hashes made at once.
LOOK_UP, SLOTS, LOOKUPS, HASH_BLOCK = 1 << 17, 4, 8, 1 << 14


def gram_codes(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` (at most 8) bytes from each place on as one number; the last places run past the end as zeros."""
    padded = np.concatenate((data, np.zeros(size, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(size):
        out |= padded[i:i + len(data)] << np.uint64(8 * i)
    return out


def _repeats(codes: np.ndarray, begin: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of n-grams that the same string has before, how many distinct n-grams each string has)."""
    again, distinct = [np.zeros(0, np.int64)], count.copy()
    at, ends = 0, np.cumsum(count)
    while at < len(count):  # some strings at a time, a very long one alone
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - count[at] + LOOK_UP, side="right")))
        some = slice(at, to)
        find = _looked_up if ends[to - 1] - ends[at] + count[at] <= AT_ONCE else _sorted_repeats
        place, string = find(codes, begin[some], count[some], size)
        again.append(place)
        distinct[some] -= np.bincount(string, minlength=to - at)
        at = to
    return np.concatenate(again), distinct


def _looked_up(codes: np.ndarray, begin: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of n-grams that the same string has before, their strings). Every string has slots of its own; the first n-gram of a slot stays
    there. Equal n-grams share a slot, so those that find their own there are repeats; those that find another one look again by another hash."""
    total = int(count.sum())
    skip = np.cumsum(count) - count
    place = np.arange(total) + np.repeat(begin - skip, count)
    code, string = codes[place], np.repeat(np.arange(len(count)), count)
    slots, first = (np.repeat((x * SLOTS).astype(np.uint64), count) for x in (count, skip))
    holds, found = np.empty(total * SLOTS, np.int32), []
    left, own = np.arange(total - 1, -1, -1, dtype=np.int32), code
    for turn in range(LOOKUPS):
        slot = own * np.uint64((0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5BA) & (1 << 64) - 1)
        slot >>= np.uint64(32)
        slot *= slots
        slot >>= np.uint64(32)
        slot += first
        slot = (slot if turn else slot[::-1].copy()).view(np.int64)
        holds[slot] = left  # last ones first: of several the last one written stays, the first of them
        there = holds[slot]
        other = np.flatnonzero(there != left)
        there, left = there[other], left[other]
        own = code[left]
        same = own == code[there]
        found.append(left[same])
        left, own = left[~same], own[~same]
        if not len(left):
            break
        if turn:
            other = other[~same]
            slots, first = slots[other], first[other]
        else:
            slots, first = slots[left], first[left]
    else:
        order = np.lexsort((left, own, string[left]))
        left, own = left[order], own[order]
        found.append(left[1:][(string[left[1:]] == string[left[:-1]]) & (own[1:] == own[:-1])])
    at = np.concatenate(found)
    return place[at], string[at]


def _sorted_repeats(codes: np.ndarray, begin: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by sorting, which takes less memory."""
    string = np.repeat(np.arange(len(count), dtype=np.int32), count)
    place = np.arange(len(string)) + np.repeat(begin - (np.cumsum(count) - count), count)
    if size <= 4 and len(codes) < 1 << 32 and (begin[1:] >= (begin + count)[:-1]).all():
        # Code and place in one number: sorted, equal codes follow by place, so a string's own are neighbours.
        both = codes[place] << np.uint64(32)
        both |= place.view(np.uint64)
        of = np.zeros(len(codes), np.int32)
        of[place] = string
        del string, place
        both.sort()
        later = np.flatnonzero((both[1:] ^ both[:-1]) >> np.uint64(32) == 0) + 1
        place, before = ((both[k] & np.uint64(0xFFFFFFFF)).view(np.int64) for k in (later, later - 1))
        place = place[of[place] == of[before]]
        return place, of[place]
    order = np.lexsort((codes[place], string))
    string, place = string[order], place[order]
    code = codes[place]
    again = np.flatnonzero((string[1:] == string[:-1]) & (code[1:] == code[:-1])) + 1
    return place[again], string[again]


def _word(mixed: np.ndarray, w: int) -> np.ndarray:
    """64 more hash bits of values that are hashes already."""
    if not w:
        return mixed
    x = mixed + np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _counts(hashes: np.ndarray, m_of: list[int]) -> list[np.ndarray]:
    """Planes of the counters of all strings. ``hashes`` has a row of words for the first n-gram of every string, then for the second of
    all that have one, and so on: ``m_of[k]`` strings have more than k."""
    top = len(m_of).bit_length()
    planes = [np.zeros((m_of[0] if m_of else 0, hashes.shape[1]), np.uint64) for _ in range(top)]
    waiting: list[np.ndarray | None] = [None] * (top + 1)
    at = 0
    for m in m_of:
        x, level = hashes[at:at + m], 0
        at += m
        while (y := waiting[level]) is not None:  # never shorter than x
            m, plane = len(x), planes[level][:len(y)]
            either = y.copy()
            either[:m] ^= x
            x = np.bitwise_and(y[:m], x, out=x)
            carry = plane & either
            carry[:m] |= x
            plane ^= either
            waiting[level] = None
            x, level = carry, level + 1
        waiting[level] = x
    for level in range(top):  # what waits alone
        x = waiting[level]
        for plane in planes[level:] if x is not None else ():
            part = plane[:len(x)]
            carry = part & x
            part ^= x
            x = carry
    return planes


def simhashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int, words: int) -> np.ndarray:
    """(strings, words) 64-bit words of the SimHash of each data[begin:end].

    Strings are not empty; those shorter than ``size`` are one n-gram.
    """
    count = np.maximum(end - begin - size + 1, 1)
    codes = gram_codes(data, size)
    short = end - begin < size
    if short.any():  # what follows such a string is not part of it
        keep = (np.uint64(1) << (np.uint64(8) * (end - begin)[short].astype(np.uint64))) - np.uint64(1)
        codes[begin[short]] &= keep
    out = np.zeros((len(begin), words), np.uint64)
    if not len(begin):
        return out
    again, distinct = _repeats(codes, begin, count, size)
    new = np.ones(len(codes), bool)
    new[again] = False
    place = np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)
    mixed = mix(codes[place[new[place]]])  # the distinct n-grams alone, string by string
    del codes, place, new
    # Pieces of at most ``LONG`` n-grams, those of most first.
    pieces = -(-distinct // LONG)
    string = np.repeat(np.arange(len(count)), pieces)
    skip = (np.arange(len(string)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LONG
    n, first = np.minimum(distinct[string] - skip, LONG), (np.cumsum(distinct) - distinct)[string] + skip
    order = np.argsort(-n, kind="stable")
    n, first, string = n[order], first[order], string[order]
    half, cut = distinct // 2, pieces > 1
    totals, of = np.zeros((int(cut.sum()), 64 * words), np.int64), np.cumsum(cut) - 1
    at, ends = 0, np.cumsum(n)
    while at < len(n):  # some pieces at a time
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + AT_ONCE, side="right")))
        own, some = string[at:to], first[at:to]
        m_of = np.searchsorted(-n[at:to], -np.arange(int(n[at])), side="left").tolist()  # pieces with more than k n-grams
        codes = mixed[np.concatenate([some[:m] + k for k, m in enumerate(m_of)])]
        hashes = np.empty((len(codes), words), np.uint64)
        for k in range(0, len(codes), HASH_BLOCK):
            part = codes[k:k + HASH_BLOCK]
            for w in range(words):
                hashes[k:k + HASH_BLOCK, w] = _word(part, w)
        planes = _counts(hashes, m_of)
        alone = np.flatnonzero(~cut[own])
        most = half[own[alone]]
        more, equal = np.zeros((len(alone), words), np.uint64), np.full((len(alone), words), ~np.uint64(0))
        for j in range(len(planes) - 1, -1, -1):  # count > half, from the highest bit down
            limit, plane = np.where(most >> j & 1, ~np.uint64(0), np.uint64(0))[:, None], planes[j][alone]
            more |= equal & plane & ~limit
            equal &= ~(plane ^ limit)
        out[own[alone]] = more
        rest = np.flatnonzero(cut[own])
        for j, plane in enumerate(planes if len(rest) else ()):
            bits = np.unpackbits(plane[rest].view(np.uint8), axis=1, bitorder="little")
            np.add.at(totals, of[own[rest]], bits.astype(np.int64) << j)
        at = to
    out[cut] = np.packbits(totals > half[cut][:, None], axis=1, bitorder="little").view(np.uint64)
    return out
