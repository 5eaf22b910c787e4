import math
import random
import re
import zlib

import numpy as np
import pytest

from blotter.llm import line_dedup, minmax_dedup, simhash
from samples import prose, prose_rows
from blotter.llm.components import components
from blotter.llm.linking import link
from blotter.llm.textbytes import mix

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_equal_brute_force(spark, odd, odd_rows):
    rng = random.Random(9)
    rows = [r for r in odd_rows if r[0] is not None] + prose_rows(rng, 100, 60)
    df = spark.createDataFrame(rows, odd.schema)
    sets = [(r[0], shingles(r[1])) for r in rows]
    u = Union()
    for i, (a, x) in enumerate(sets):
        u.find(a)
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                u.join(a, b)
    got = minmax_dedup.near_duplicates(df.withColumnRenamed("lang", "bucket").withColumnRenamed("source", "id")).collect()
    want = sorted((r[0], len(shingles(r[1])), u.find(r[0]), u.find(r[0]) == r[0]) for r in rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert len({w[2] for w in want}) < len({r[0] for r in rows}) - 10  # there are groups to find


def test_null_keys_and_no_rows(odd, none):
    got = [r for r in minmax_dedup.near_duplicates(odd).collect() if r.doc_id is None]
    assert len(got) == 2 and all(r.component_id is None and r.kept for r in got)
    assert minmax_dedup.near_duplicates(none).count() == 0


def test_texts_of_one_key_are_told_apart(spark, odd):
    rng = random.Random(12)
    one, two, three = (" ".join(prose_rows(rng, 0, 1)[0][1].split()[:60]) for _ in range(3))
    near = lambda t: t + " more"
    rows = [(7, one), (7, two), (8, near(two)), (9, near(one)), (5, three), (5, near(three))]
    df = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], odd.schema)
    hashes = {r.h: r.text for r in df.selectExpr("xxhash64(text) AS h", "text").collect()}
    got = {(r.doc_id, hashes[r.text_hash]): (r.component_id, r.kept) for r in minmax_dedup.near_duplicates(df).collect()}
    assert got[7, one] == got[7, two] == (7, True) and got[8, near(two)] == got[9, near(one)] == (7, False)
    assert sorted(got[5, t] for t in (three, near(three))) == [(5, False), (5, True)]


def _line_nodes(rows):
    """Distinct normalised lines with their places, in first-seen order."""
    places = {}
    for i, r in enumerate(rows):
        for n, text in enumerate((r[1] or "").split("\n")):
            if w := b" ".join(words(text)).decode():
                places.setdefault(w, []).append((i, n))
    return places


def _hash(line):
    """The SimHash by plain counting over the distinct runs of bytes, as a list of bits."""
    raw, size = line.encode(), line_dedup.GRAM
    codes = sorted({int.from_bytes(raw[k:k + size], "little") for k in range(max(len(raw) - size + 1, 1))})
    mixed, bits = mix(np.array(codes, np.uint64)), []
    for w in range(line_dedup.HASH_WORDS):
        each = simhash._word(mixed, w)
        bits += [int(2 * ((each >> np.uint64(b)) & np.uint64(1)).sum() > 2 * (len(codes) // 2)) for b in range(64)]
    return bits


def _line_links(lines):
    """Linked pairs by the rules: a shared block and class, a mate there, the radius, the edit similarity."""
    hashes = {w: _hash(w) for w in lines}
    apart = lambda a, b, n: sum(x != y for x, y in zip(hashes[a][:n], hashes[b][:n]))
    buckets = {}
    for w in lines:
        if len(w) >= 7:
            for c in {int(math.log2(len(w))), int(math.log2(len(w) * 100 / 85))}:
                for b in range(line_dedup.BLOCKS):
                    buckets.setdefault((c, b, tuple(hashes[w][16 * b:16 * b + 16])), []).append(w)
    for own in buckets.values():
        mated = [a for a in own if any(a != b and apart(a, b, 128) <= 0.28 * 128 for b in own)]
        mated = [a for a in mated if any(a != b and apart(a, b, 256) <= 64 for b in mated)]
        for i, a in enumerate(mated):
            for b in mated[:i]:
                most = max(len(a), len(b))
                if apart(a, b, 256) <= 64 and line_dedup.edit_distance(a, b) * 100 <= 15 * most:
                    yield a, b


def brute_lines(rows):
    places, u = _line_nodes(rows), Union()
    for a, b in _line_links(list(places)):
        u.join(a, b)
    first = {}
    key = lambda p: (rows[p[0]][0] is not None, rows[p[0]][0] or 0, p[1])
    for w in places:
        root = u.find(w)
        least = min(map(key, places[w]))
        first[root] = min(first.get(root, least), least)
    gone = {i: set() for i in range(len(rows))}
    for w in places:
        for p in places[w]:
            if key(p) != first[u.find(w)]:
                gone[p[0]].add(p[1])
    return [None if r[1] is None else "\n".join(t for n, t in enumerate(r[1].split("\n")) if n not in gone[i])
            for i, r in enumerate(rows)], u


def test_lines_equal_brute_force(spark, odd, odd_rows):
    rng = random.Random(3)
    extra = prose_rows(rng, 100, 40, lines=True)
    rows = odd_rows + extra
    df = spark.createDataFrame(rows, odd.schema).withColumnRenamed("lang", "removed_lines").withColumnRenamed("source", "line")
    got = line_dedup.dedup_lines(df).collect()
    want, u = brute_lines(rows)
    assert sorted((r.doc_id or -1, str(r.text)) for r in got) == sorted((r[0] or -1, str(t)) for r, t in zip(rows, want))
    assert any(u.find(x) != x for x in u.up)  # some lines are near, not equal


def changed_lines(rng, n, times):
    """(line, a near one): one changed word, a tenth of the words, one more letter, in turn."""
    for i in range(times):
        line = prose(rng, n).split(" ")
        near = list(line)
        for at in rng.sample(range(n), 1 if i % 3 == 0 else max(1, n // 10) if i % 3 == 1 else 0):
            near[at] = prose(rng, 1)
        if i % 3 == 2:
            near[rng.randrange(n)] += "x"
        yield " ".join(line), " ".join(near)


@pytest.mark.parametrize("n,least", [(20, 0.7), (30, 0.75), (50, 0.8), (100, 0.8), (200, 0.85)])
def test_share_of_near_lines_found(n, least):
    """Of pairs that are near by edit similarity alone, the share that the blocks and the radius find."""
    rng = random.Random(n)
    pairs = [(a, b) for a, b in changed_lines(rng, n, 90) if a != b and line_dedup.edit_distance(a, b) * 100 <= 15 * max(len(a), len(b))]
    found = sum(any(True for _ in _line_links([a, b])) for a, b in pairs)
    assert len(pairs) > 50 and found >= least * len(pairs)


def test_simhashes_of_many_strings():
    rng = random.Random(0)
    texts = [bytes(rng.choice(b"abcde ") for _ in range(rng.choice([1, 2, 3, 4, 9, 50, 200, 1027, 1028, 3000]))) for _ in range(120)]
    ends = np.cumsum([len(t) for t in texts])
    got = simhash.simhashes(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends, 4, 4)
    for text, words_ in zip(texts, got):
        assert np.unpackbits(words_.view(np.uint8), bitorder="little").tolist() == _hash(text.decode())


def test_repeated_runs_by_either_way():
    """Runs of four bytes are found by one sort of code and place, longer ones by code and string."""
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(4, 60))) for _ in range(200)]
    data, end = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    begin = end - [len(t) for t in texts]
    codes, count = simhash.gram_codes(data, 4), end - begin - 3
    (one, some), (two, other) = (simhash._repeats(codes, begin, count, size) for size in (4, 5))
    assert sorted(one) == sorted(two) and len(one) and some.tolist() == other.tolist()


def test_memory_of_the_line_pass():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(4)
    texts = ["\n".join(prose(rng, 40) for _ in range(10)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], names=["key", "text"])
    assert batch.nbytes > 4_000_000
    list(line_dedup._lines(iter([batch.slice(0, 9)])))  # tables that a worker keeps
    tracemalloc.start()
    list(line_dedup._lines(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_edit_distance_with_a_bound():
    rng = random.Random(5)
    for _ in range(300):
        a, b = prose(rng, rng.randint(0, 12)), prose(rng, rng.randint(0, 12))
        b = a[:len(a) // 2] + b if rng.random() < 0.5 else b
        whole = line_dedup.edit_distance(a, b)
        for most in (0, 3, 20, 60):
            bounded = line_dedup.edit_distance(a, b, most)
            assert bounded == whole if whole <= most else bounded > most


def test_many_pairs_within_a_bound():
    """The diagonals of many pairs at once decide as one distance after the other does."""
    rng = random.Random(6)
    one, two, most = ["", "", "a"], ["", "abc", "a"], [0, 2, 0]
    for n in [1, 2, 7, 20, 60, 200, 700] * 40:
        a = [rng.choice("abcdeé😀") for _ in range(n)]
        b = list(a)
        for at in sorted(rng.sample(range(n), rng.randint(0, max(1, n // 6))), reverse=True):
            b[at:at + 1] = rng.choice([[], ["q"], [b[at], "z"]])
        one.append("".join(a))
        two.append("".join(b))
        most.append(rng.choice([rng.randint(0, 30), 15 * max(len(a), len(b)) // 100]))
    want = [line_dedup.edit_distance(a, b) <= m for a, b, m in zip(one, two, most)]
    assert line_dedup._within(one, two, most).tolist() == want
    assert 50 < sum(want) < len(want) - 20


def test_lines_with_mates_by_passes(spark):
    """The passes over the blocks together find what all blocks at once do, and each shuffles its own blocks alone."""
    rng = random.Random(10)
    lines = sorted({w for a, b in changed_lines(rng, 30, 40) for w in (a, b)})
    hashes = [np.packbits(_hash(w), bitorder="little").view(np.int64).tolist() for w in lines]
    nodes = spark.createDataFrame([(i, len(w), *h) for i, (w, h) in enumerate(zip(lines, hashes))],
                                  "id long, chars int, " + ", ".join(f"{c} long" for c in line_dedup.HASH))
    parts = line_dedup._members(nodes, 85)
    assert len(parts) == line_dedup.PASSES > 1
    near = lambda i, j, n: (100 * min(len(lines[i]), len(lines[j])) >= 85 * max(len(lines[i]), len(lines[j])) and
                            sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in list(zip(hashes[i], hashes[j]))[:n // 64]))
    for part, first in zip(parts, range(0, line_dedup.BLOCKS, line_dedup.BLOCKS // line_dedup.PASSES)):
        blocks = range(first, first + line_dedup.BLOCKS // line_dedup.PASSES)
        buckets = {}
        for i, w in enumerate(lines):
            for c in {int(math.log2(len(w))), int(math.log2(len(w) * 100 / 85))}:
                for b in blocks:
                    bits = hashes[i][b // 4] >> 16 * (b % 4) & 0xFFFF
                    buckets.setdefault(((c * line_dedup.BLOCKS + b) << 16) | bits, []).append(i)
        want = set()
        for bucket, own in buckets.items():
            for n, most in ((128, 35), (256, 64)):
                close = lambda i, j: near(i, j, n) is not False and near(i, j, n) <= most  # noqa: B023, E731
                own = [i for i in own if any(i != j and close(i, j) for j in own)]
            want |= {(bucket, i) for i in own}
        assert {(r.bucket, r.id) for r in part.collect()} == want
        rows = nodes.mapInArrow(line_dedup._deal(85, blocks, 5), "range long, rows binary").collect()
        assert sum(len(r.rows) for r in rows) == 48 * sum(map(len, buckets.values()))
    assert sum(p.count() for p in parts) > 40


def test_repeated_runs_by_slots(monkeypatch):
    """Repeats are found by slots as by plain search, also when lookups end early and the rest is sorted, and when a string is sorted whole."""
    rng = random.Random(12)
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.choice([4, 5, 9, 60, 300, 3000]))) for _ in range(150)]
    data, end = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    begin = end - [len(t) for t in texts]
    want, kinds = [], []
    for t, start in zip(texts, begin.tolist()):
        runs = [t[k:k + 4] for k in range(len(t) - 3)]
        want += [start + k for k, r in enumerate(runs) if r in runs[:k]]
        kinds.append(len(set(runs)))
    for lookups, at_once, look_up in ((8, 1 << 20, 1 << 17), (1, 1 << 20, 1000), (2, 1 << 20, 1), (8, 500, 1000)):
        monkeypatch.setattr(simhash, "LOOKUPS", lookups)
        monkeypatch.setattr(simhash, "AT_ONCE", at_once)
        monkeypatch.setattr(simhash, "LOOK_UP", look_up)
        again, distinct = simhash._repeats(simhash.gram_codes(data, 4), begin, end - begin - 3, 4)
        assert sorted(again.tolist()) == want and distinct.tolist() == kinds


def test_every_byte_as_word_and_lower_case():
    from blotter.llm import textbytes

    data = np.arange(256, dtype=np.uint8)
    assert (textbytes.lower(data) == textbytes.LOWER).all()
    found = textbytes.words(np.repeat(data, 2), np.arange(0, 513, 2))  # a row for each byte
    assert found.row.tolist() == np.flatnonzero(~textbytes.SPACE).tolist() and (found.end - found.start == 2).all()


def test_only_distinct_runs_are_hashed(monkeypatch):
    """A run that comes again in its line adds to no count, so it costs no hashes."""
    seen, word = [], simhash._word
    monkeypatch.setattr(simhash, "_word", lambda mixed, w: seen.append(len(mixed)) or word(mixed, w))
    text = b"abcdefgh" * 100
    got = simhash.simhashes(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]), 4, 4)
    assert sum(seen) == 4 * 8 and np.unpackbits(got[0].view(np.uint8), bitorder="little").tolist() == _hash(text.decode())


def test_only_lines_of_near_lengths_are_compared(monkeypatch):
    """In a bucket, SimHashes are compared only of lines whose lengths the edit similarity allows."""
    rng = np.random.default_rng(13)
    bucket, chars = rng.integers(0, 4, 300), rng.integers(64, 128, 300)
    key = np.sort(bucket << 32 | chars)
    hashes = rng.integers(0, 4, (300, 2)).astype(np.uint64)
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(len(x)) or count(x))
    got = line_dedup._mated(key, hashes, 0, 85)
    monkeypatch.undo()
    near = [(i, j) for i in range(300) for j in range(i) if key[i] >> 32 == key[j] >> 32
            and 100 * min(key[i] & 0xFFFF, key[j] & 0xFFFF) >= 85 * max(key[i] & 0xFFFF, key[j] & 0xFFFF)]
    want = {k for i, j in near if (hashes[i] == hashes[j]).all() for k in (i, j)}
    assert set(np.flatnonzero(got).tolist()) == want and 0 < len(want) and sum(compared) <= 2 * len(near)


def test_only_near_lines_are_joined_from_their_words(spark, monkeypatch):
    """Lines that the sieve drops are not put together."""
    import pyarrow as pa

    texts = pa.array(["\n".join(f"line {i} {k}  of words" for k in range(5)) for i in range(100)] + [None, "", " "])
    _, _, prints = line_dedup.fingerprints(texts)
    asked = spark.createDataFrame([tuple(p) for p in prints.view(np.int64)[[3, 77, 499]].tolist()], "high long, low long")
    sieve = spark.sparkContext.broadcast(line_dedup._sieve(asked, 3))
    joined, normalised = [], line_dedup.normalised
    monkeypatch.setattr(line_dedup, "normalised", lambda data, spans, line: joined.append(len(line)) or normalised(data, spans, line))
    got = [w for b in line_dedup._line_texts(sieve)(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])) for w in b.column("words").to_pylist()]
    assert {"line 0 3 of words", "line 15 2 of words", "line 99 4 of words"} <= set(got) and len(got) < 40 and sum(joined) == 5 * len(got)


def test_long_pairs_by_pieces():
    """Pieces of a long pair add up to its edit distance or more, and decide alike."""
    rng = random.Random(14)
    one, two, most = [], [], []
    for n in (2100, 3000, 5000):
        for share in (0.01, 0.1, 0.14, 0.2):
            a = [rng.choice("abcdeé") for _ in range(n)]
            b = list(a)
            for at in sorted(rng.sample(range(n), int(n * share)), reverse=True):
                b[at:at + 1] = rng.choice([[], ["q"], [b[at], "z"]])
            one.append("x" + "".join(a) + "y")
            two.append("z" + "".join(b) + "w")
            most.append(15 * max(len(one[-1]), len(two[-1])) // 100)
    whole = [line_dedup.edit_distance(a, b) for a, b in zip(one, two)]
    assert all(line_dedup._most_edits(a, b, 10**6) >= w for a, b, w in zip(one, two, whole))
    assert line_dedup._within(one, two, most).tolist() == [w <= m for w, m in zip(whole, most)] and len(set(line_dedup._within(one, two, most))) == 2


def test_only_the_words_of_near_lines_leave_the_tasks(spark):
    rng = random.Random(11)
    docs = spark.createDataFrame([("\n".join([prose(rng, 5), "One  Line", prose(rng, 5)]),) for _ in range(200)] + [(None,)], "text string")
    import pyarrow as pa

    row, line, prints = line_dedup.fingerprints(pa.array(["one line"]))
    asked = spark.createDataFrame([tuple(prints.view(np.int64)[0].tolist())], "high long, low long")
    sieve = spark.sparkContext.broadcast(line_dedup._sieve(asked, 1))
    got = docs.repartition(1).mapInArrow(line_dedup._line_texts(sieve), "high long, low long, words string").collect()
    assert "one line" in {r.words for r in got} and len(got) < 40


def test_crowded_buckets_of_near_lines(spark, odd):
    """600 near copies of one line and 600 far ones: one stays of the former."""
    rng = random.Random(9)
    line = prose(rng, 60).split(" ")
    texts = []
    for i in range(600):
        copy = list(line)
        copy[i % 60] = prose(rng, 1)
        texts += [" ".join(copy), prose(rng, 60)]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], odd.schema)
    left = {r.doc_id for r in line_dedup.dedup_lines(df).where("removed_lines = 0").collect()}
    assert {i for i in left if i % 2} == set(range(1, 1200, 2)) and len([i for i in left if i % 2 == 0]) <= 3



def test_lines_of_nothing(none):
    assert line_dedup.dedup_lines(none).count() == 0


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert line_dedup.edit_distance(a, b) == row[-1]


def test_components_of_paths_stars_and_cliques(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(200 + i, 200 + j) for i in range(8) for j in range(i)]
    edges += [(5, 5), (9, 5), (5, 9)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(80)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in u.up if u.find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_link_loses_no_pair_of_a_large_bucket(spark):
    """One bucket of 400 numbers, linked if they differ by one: leaders alone would find few."""
    members = spark.createDataFrame([(1, i) for i in range(400)] + [(2, i) for i in range(390, 410)] + [(3, 1000)], "bucket long, id long")
    seen = []

    def verify(pairs):
        seen.append(pairs.count())
        return pairs.where("b - a = 1")

    got = {r.id: r.root for r in link(members, verify).collect()}
    assert got == {i: 0 for i in range(1, 410)}


def test_copies_need_one_pair_each(spark):
    members = spark.createDataFrame([(b, i) for b in range(3) for i in range(500)], "bucket long, id long")
    tested = []

    def verify(pairs):
        tested.append(pairs.count())
        return pairs

    assert link(members, verify).count() == 499
    assert sum(tested) <= 499


def test_crc_of_left_text_is_stable(spark, odd):
    texts = [sorted(zlib.crc32((r.text or "").encode()) for r in line_dedup.dedup_lines(odd.repartition(n)).collect()) for n in (1, 5)]
    assert texts[0] == texts[1]
