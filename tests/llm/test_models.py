import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import prose, row

from blotter.llm import nbsvm, suffix_tree

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def junk(rng, n):
    return " ".join(prose(rng, 1).upper() + "!!" for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark, odd, odd_rows):
    rng = random.Random(6)
    rows = odd_rows + [row(1000 + i, junk(rng, rng.randint(5, 200)) if i % 4 == 0 else prose(rng, rng.randint(5, 200))) for i in range(240)]
    labels = [(1000 + i, int(i % 4 != 0), 0) for i in range(240)] + [(5, None, 0), (None, 1, 0), (1000, 1, 0), (43, 1, 0)]
    return spark.createDataFrame(rows, odd.schema), spark.createDataFrame(labels, "doc_id long, quality int, score int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    learn = labels.where(~nbsvm.held_out(F.col("doc_id")))
    scored = nbsvm.scores(docs.withColumnRenamed("lang", "score"), nbsvm.fit(docs, learn))
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.doc_id and r.doc_id >= 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= 0.3) == ((r.doc_id - 1000) % 4 != 0) for r in out)
    assert len(out) > 20 and right / len(out) > 0.95


def test_fits_without_labels_or_with_one_class(labelled, none):
    docs, labels = labelled
    nothing = nbsvm.fit(docs, labels.limit(0))
    assert {r.score for r in nbsvm.scores(docs, nothing).collect()} == {0.5}
    good = nbsvm.fit(docs, labels.where("quality = 1 AND doc_id <> 1000"))
    assert all(r.score > 0.9 for r in nbsvm.scores(docs, good).collect())
    assert nbsvm.scores(none, nothing).count() == 0


def plain_fit(sets, good, rng):
    """Dictionary version of the ratios and the descent: (ratio, weight of each feature, bias)."""
    counts = {True: Counter(), False: Counter()}
    for f, g in zip(sets, good):
        counts[g].update(f)
    whole = {g: nbsvm.DIMS + sum(c.values()) for g, c in counts.items()}
    ratio = {f: math.log((1 + counts[True][f]) / whole[True]) - math.log((1 + counts[False][f]) / whole[False])
             for f in range(nbsvm.DIMS)}
    share = sum(good) / len(good)
    most = [nbsvm.COST * 0.5 / (share if g else 1 - share) for g in good]
    size = [math.sqrt(sum(ratio[f] ** 2 for f in own)) for own in sets]
    weight, bias, dual = Counter(), 0.0, [0.0] * len(sets)
    for _ in range(nbsvm.ROUNDS):
        moved = 0.0
        for i in rng.permutation(len(sets)).tolist():
            sign = 1 if good[i] else -1
            slope = sign * (sum(weight[f] * ratio[f] / size[i] for f in sets[i]) + bias) - 1
            length = 2 if sets[i] else 1  # the indicators have length one, the bias another
            new = min(max(dual[i] - slope / length, 0.0), most[i])
            step, dual[i] = (new - dual[i]) * sign, new
            for f in sets[i]:
                weight[f] += step * ratio[f] / size[i]
            bias, moved = bias + step, max(moved, abs(step))
        if moved < 1e-3:
            break
    return ratio, weight, bias


def plain_margin(model, own, ratio):
    """Features that no fit saw have ratios too, so every feature counts in the length."""
    _, weight, bias = model
    return sum(weight[f] * ratio[f] for f in own) / max(math.sqrt(sum(ratio[f] ** 2 for f in own)), 1e-12) + bias


def test_scores_equal_a_dictionary_version(spark, odd, odd_rows):
    """Ratios, margins, folds and scores over odd rows too: a key labelled both ways is bad, of its texts the least is learnt."""
    import pyarrow as pa
    rng = random.Random(16)
    rows = odd_rows + [row(1000 + i, junk(rng, rng.randint(3, 12)) if i % 3 == 0 else prose(rng, rng.randint(3, 25))) for i in range(40)]
    labels = [(1000 + i, int(i % 3 != 0)) for i in range(40)] + [(5, None), (None, 1), (1001, 0), (40, 0), (41, 1), (47, 1), (777, 1)]
    docs = spark.createDataFrame(rows, odd.schema)
    got = nbsvm.scores(docs, nbsvm.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))).select("doc_id", "text", "score").collect()

    def features_of(text):
        return nbsvm.features(pa.array([text], pa.string()))[1].tolist()

    texts, label = {}, {}
    for r in rows:
        texts[r[0]] = min((t for t in (texts.get(r[0]), r[1]) if t is not None), default=None)
    for k, v in labels:
        if k is not None and v is not None:
            label[k] = min(v, label.get(k, 1))
    order = spark.createDataFrame([(k,) for k in label if k in texts], "key long").orderBy(F.xxhash64("key")).collect()
    keys = [r.key for r in order]
    sets, good = [features_of(texts[k]) for k in keys], [label[k] == 1 for k in keys]
    fold, seen = [], Counter()
    for g in good:
        fold.append(seen[g] % 3)
        seen[g] += 1
    margin = [0.0] * len(keys)
    for k in range(3):
        inside = [i for i in range(len(keys)) if fold[i] != k]
        model = plain_fit([sets[i] for i in inside], [good[i] for i in inside], np.random.default_rng(5))
        for i in set(range(len(keys))) - set(inside):
            margin[i] = plain_margin(model, sets[i], model[0])
    slope, offset = nbsvm.logistic(np.array(margin), np.array(good))
    ones, zeros = sum(v == 1 for v in label.values()), sum(v == 0 for v in label.values())
    offset += math.log((ones + 1) / (zeros + 1))
    model = plain_fit(sets, good, np.random.default_rng(5))
    want = {t: 1 / (1 + math.exp(-(slope * plain_margin(model, features_of(t), model[0]) + offset))) for t in {r[1] for r in rows}}
    assert len(got) == len(rows) and len(set(want.values())) > 40
    for r in got:
        assert r.score == pytest.approx(want[r.text], abs=1e-6), r.doc_id


def test_features_are_sets_of_whole_texts():
    import pyarrow as pa
    texts = ["ab", "abab" * 100, None, "", "b"]
    row_, feature = nbsvm.features(pa.array(texts, pa.string()))
    sets = [set(feature[row_ == i].tolist()) for i in range(5)]
    assert not sets[2] and not sets[3] and sets[4] < sets[0] | sets[4] and len(feature) == sum(map(len, sets))
    alone = nbsvm.features(pa.array(texts[1:2]))[1]
    assert set(alone.tolist()) == sets[1]


def test_descent_reaches_the_dual_optimum():
    """On a tiny problem the duality gap closes."""
    rng = np.random.default_rng(3)
    x = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(40)]
    x = [f if len(f) else np.array([0]) for f in x]
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    values, cost = rng.standard_normal(12), np.full(40, 0.5)
    w, b = nbsvm.descend(x, values, y, cost, rounds=3000)
    dense = np.zeros((40, 13))
    for i, f in enumerate(x):
        v = values[f] / np.sqrt((values[f] ** 2).sum())
        dense[i, f], dense[i, 12] = v, 1
    full = np.append(w, b)
    primal = 0.5 * full @ full + (cost * np.maximum(0, 1 - y * (dense @ full))).sum()
    best = min(0.5 * v @ v + (cost * np.maximum(0, 1 - y * (dense @ v))).sum()
               for v in (full + 0.05 * rng.standard_normal(13) for _ in range(2000)))
    assert primal <= best + 1e-3


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW)) + [None]


def test_base_scores_and_counts(labelled):
    docs, _ = labelled
    out = nbsvm.held_out(F.col("doc_id"), rest=1)
    rows = docs.collect()
    counts = Counter()
    for r in rows:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    got = suffix_tree.score(docs, *suffix_tree.fit(docs.where(~out))).collect()
    want = sorted((r.doc_id or -1, len(tokens(r.text)), sum(t in counts for t in tokens(r.text)), n,
                   sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(r.text))) for r in rows)
    have = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(have, want, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
    assert all(r.score < 0 for r in got)


def brute(texts):
    """A dictionary version of the tree: (probability of a token after a history, unseen share)."""
    seqs = [tokens(t) for t in texts]
    uni = Counter(t for s in seqs for t in s)
    n, v = sum(uni.values()), len(uni)
    once, twice = (sum(c == k for c in uni.values()) for k in (1, 2))
    d = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
    after = {}
    for s in seqs:
        full = [None] + s
        for i in range(1, len(full)):
            for k in range(0, suffix_tree.DEPTH + 1):
                if i - k < 0:
                    break
                after.setdefault(tuple(full[i - k:i]), Counter())[full[i]] += 1
    kept = {()}
    for context, own in after.items():
        if context and sum(own.values()) >= suffix_tree.LEAST_COUNT:
            total, up = sum(own.values()), after[context[1:]]
            gain = sum(c * math.log(c / total / (up[x] / sum(up.values()))) for x, c in own.items())
            if gain >= suffix_tree.DIVERGENCE:
                kept.update(context[i:] for i in range(len(context)))

    def p(x, context):
        if not context:
            return (uni[x] - d) / n if x in uni else d * v / n
        own = after[context]
        total = sum(own.values())
        return (own[x] + len(own) * p(x, context[1:])) / (total + len(own))

    def score(text):
        full, out = [None] + tokens(text), 0.0
        for i in range(1, len(full)):
            context = next(c for k in range(min(suffix_tree.DEPTH, i), -1, -1) if (c := tuple(full[i - k:i])) in kept)
            out += math.log10(p(full[i], context))
        return out

    return score, kept


def test_tree_equals_a_dictionary_version(spark):
    """With few tokens every seen token is frequent, so no class of others is in play."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a b c", "a b d", "x", "y z", "a", "b a c"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, rare = suffix_tree.fit(df)
    score, kept = brute(texts)
    assert any(len(c) == 1 for c in kept) and sum(map(len, model.contexts)) == len(kept) - 1
    probes = texts + ["a b q", "", "q q q", "z y x a b c d"]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(probes)], "doc_id long, text string")
    for r in suffix_tree.score(asked, model, rare).collect():
        assert r.score == pytest.approx(score(probes[r.doc_id]), rel=1e-6)


@pytest.mark.parametrize("small", [{"HOT": 20}, {"BUCKET": 50, "CODED": 100}, {"HOT": 20, "BUCKET": 50, "CODED": 100, "PASSES": 2}])
def test_the_tree_is_the_same_in_parts(spark, odd, odd_rows, monkeypatch, small):
    """Many chunks, buckets and passes, and words too frequent for a bucket, over odd rows too."""
    for name, value in small.items():
        monkeypatch.setattr(suffix_tree, name, value)
    rng = random.Random(18)
    rows = odd_rows + [row(2000 + i, " ".join(rng.choice(["a b c", "a b d", "x", "y z", "a", "b a c"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    train = [r for r in rows if r[0] != 43]
    score, kept = brute([r[1] for r in train])
    df = spark.createDataFrame(rows, odd.schema)
    model, seen = suffix_tree.fit(df.where("doc_id IS NULL OR doc_id <> 43"))
    assert any(len(c) == 2 for c in kept) and sum(map(len, model.contexts)) == len(kept) - 1
    got = suffix_tree.score(df, model, seen).collect()
    want = sorted((r[0] or -1, len(tokens(r[1])), score(r[1])) for r in rows)
    for a, b in zip(sorted((r.doc_id or -1, r.n_tokens, r.score) for r in got), want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)


def test_no_staged_table_has_a_row_for_each_window(spark, monkeypatch):
    rng = random.Random(19)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(200)], k=500)) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    staged, stage = [], suffix_tree.stage

    def counted(frame, label):
        out = stage(frame, label)
        staged.append(out.count())
        return out

    monkeypatch.setattr(suffix_tree, "stage", counted)
    assert suffix_tree.score(df, *suffix_tree.fit(df)).count() == 40
    assert len(staged) > 3 and max(staged) < 2_000


def test_distributions_sum_to_one(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, " ".join(rng.choice("abcdefg") for _ in range(40))) for i in range(40)], "doc_id long, text string")
    model, _ = suffix_tree.fit(df)
    ids = np.append(np.arange(len(model.words.count)), suffix_tree.OTHER)
    for state in range(len(model.parent)):
        assert (10 ** model.after(np.full(len(ids), state), ids)).sum() == pytest.approx(1, abs=1e-9)


def test_a_context_of_a_small_share_is_kept(spark):
    """30 of 700,000 positions: what follows is known by the count, whatever else the corpus holds."""
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcdefgh", k=1000)) for _ in range(700)] + ["zulu yankee"] * 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, seen = suffix_tree.fit(df)
    asked = spark.createDataFrame([(0, "zulu yankee")], "doc_id long, text string")
    assert suffix_tree.score(asked, model, seen).first().score > math.log10(0.9 * 30 / 730)


def test_no_training_texts(none, odd):
    model, rare = suffix_tree.fit(none)
    rows = suffix_tree.score(odd, model, rare).collect()
    assert len(rows) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in rows)
    assert suffix_tree.score(none, model, rare).count() == 0
