"""Quality classifier: a linear SVM on n-gram indicators scaled by naive-Bayes log-count ratios.

Features of a text are the sets of its byte n-grams (1 to 3, case kept) and of the n-grams of its
word shapes (1 to 3), hashed to ``DIMS`` numbers. The ratio r of a feature is the log of its smoothed
share among good texts over its share among bad ones. An indicator x becomes r * x, scaled to
length one; dual coordinate descent fits the hinge loss on these. Margins of sampled documents under fits
that did not see them give the slope and offset of the score's logistic, moved to the share of good rows
among all labels.

The fit sees a bounded sample: ``PER_CLASS`` labelled documents of each class, by smallest hash of the
id. Scoring sees every document whole. Texts are turned into features by numpy inside tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import chunks, mix, row_bytes, span_hashes, words

DIMS, PER_CLASS, ROUNDS, COST, ROWS_AT_ONCE = 1 << 16, 3000, 30, 1.0, 128
_FOLD = np.uint64(64 - 16)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + offset)))."""

    weight: np.ndarray  # ratio * SVM weight
    square: np.ndarray  # ratio ** 2
    bias: float
    slope: float
    offset: float

    def score(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        total = np.bincount(row, weights=self.weight[feature], minlength=rows)
        length = np.sqrt(np.bincount(row, weights=self.square[feature], minlength=rows))
        margin = total / np.maximum(length, 1e-12) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shape) of each word: length, capitals, digits, other scripts, last byte, repetition."""
    spans = words(data, offsets)
    if not len(spans.start):
        return spans.row, np.zeros(0, np.uint64)
    upper = np.concatenate(([0], np.cumsum((data >= 0x41) & (data <= 0x5A))))
    digit = np.concatenate(([0], np.cumsum((data >= 0x30) & (data <= 0x39))))
    other = np.concatenate(([0], np.cumsum(data >= 0x80)))
    length = spans.end - spans.start
    capitals = np.minimum(upper[spans.end] - upper[spans.start], 3)
    last = data[spans.end - 1].astype(np.int64)
    last = np.where((last >= 0x80) | ((last | 0x20) >= 0x61) & ((last | 0x20) <= 0x7A), 0, last)
    hashes = span_hashes(spans)
    same = np.zeros(len(length), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (spans.row[1:] == spans.row[:-1])
    shape = np.minimum(length, 15) // 3
    for value, size in ((capitals, 4), (np.minimum(digit[spans.end] - digit[spans.start], 2), 3),
                        ((other[spans.end] > other[spans.start]).astype(np.int64), 2), (last, 256), (same, 2)):
        shape = shape * size + value
    return spans.row, mix(shape.astype(np.uint64))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), each once, rows ascending. Null and empty texts have none."""
    data, offsets = row_bytes(column)
    rows = len(offsets) - 1
    seen = np.zeros(rows * DIMS, dtype=bool)
    base = np.repeat(np.arange(rows) * DIMS, np.diff(offsets))
    wide = data.astype(np.uint64)
    code = np.zeros(len(data), np.uint64)
    end = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes to the row's end
    for n in range(1, 4):
        m = len(data) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint64(8)) | wide[n - 1:]
        at = (code + np.uint64(n << 32)) * np.uint64(0x9E3779B97F4A7C15) >> _FOLD
        inside = end[:m] >= n
        seen[base[:m][inside] + at[inside].astype(np.int64)] = True
    row, shape = _shapes(data, offsets)
    code = np.zeros(len(shape), np.uint64)
    for n in range(1, 4):
        m = len(shape) - n + 1
        if m <= 0:
            break
        code = mix(code[:m] * np.uint64(3) + shape[n - 1:] + np.uint64(n))
        inside = row[:m] == row[n - 1:]
        seen[row[:m][inside] * DIMS + (code[inside] >> _FOLD).astype(np.int64)] = True
    found = np.flatnonzero(seen)
    return found // DIMS, found % DIMS


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks(batch, text):
            for at in range(a, b, ROWS_AT_ONCE):
                yield batch.slice(at, min(ROWS_AT_ONCE, b - at))


def descend(x: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Hinge-loss weights by dual coordinate descent; ``x`` are feature numbers, ``values`` their size.

    The bias is one more feature of size one.
    """
    rng = np.random.default_rng(5)
    w, bias = np.zeros(len(values)), 0.0
    alpha = np.zeros(len(x))
    scaled = [values[f] / max(float(np.sqrt((values[f] ** 2).sum())), 1e-12) for f in x]
    norm = np.array([float((v * v).sum()) + 1.0 for v in scaled])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * (w[x[i]] @ scaled[i] + bias) - 1
            if (gradient >= 0 and alpha[i] == 0) or (gradient <= 0 and alpha[i] == cost[i]):
                continue
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            moved = max(moved, abs(step))
            alpha[i] = new
            w[x[i]] += step * scaled[i]
            bias += step
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic on margins, classes weighing the same, targets smoothed."""
    pos, neg = max(good.sum(), 1), max((~good).sum(), 1)
    target = np.where(good, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(good, 0.5 / pos, 0.5 / neg)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([(g * margin).sum() + 1e-4 * a, g.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-4, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b


def _linear(x: list[np.ndarray], good: np.ndarray) -> Model:
    """Ratios and SVM weights, classes weighing the same."""
    p, q = np.ones(DIMS), np.ones(DIMS)
    for f, g in zip(x, good):
        (p if g else q)[f] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    share = min(max(good.mean(), 1e-9), 1 - 1e-9)
    cost = COST * 0.5 / np.where(good, share, 1 - share)
    w, bias = descend(x, ratio, np.where(good, 1.0, -1.0), cost)
    return Model(ratio * w, ratio * ratio, bias, 1.0, 0.0)


def train(x: list[np.ndarray], good: np.ndarray, prior: float, folds: int = 3) -> Model:
    """Fit on sampled feature sets; margins of documents kept out of a fold's fit set the logistic."""
    if not len(x) or good.all() or not good.any():
        sure = 0.0 if not len(x) else math.log((good.sum() + 1) / ((~good).sum() + 1))
        return Model(np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0, sure)
    fold = np.zeros(len(x), np.int64)
    for own in (good, ~good):  # each class spread evenly
        fold[own] = np.arange(own.sum()) % folds
    margin = np.zeros(len(x))
    for k in range(folds):
        out = np.flatnonzero(fold == k)
        model = _linear([f for f, own in zip(x, fold) if own != k], good[fold != k])
        for i in out:
            margin[i] = model.weight[x[i]].sum() / max(math.sqrt(model.square[x[i]].sum()), 1e-12) + model.bias
    model = _linear(x, good)
    model.slope, model.offset = logistic(margin, good)
    model.offset += math.log(prior / (1 - prior))
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        per_class: int = PER_CLASS) -> Model:
    """Learn from the rows of ``labels`` (key, label 0 or 1); pass only those that may be learnt from.

    Null keys and labels are left out; a key labelled both ways counts as 0, and of several texts of one key
    the smallest is learnt. Without labels every score is 0.5; with one class only, near that class.
    """
    labels = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(
        F.min(label).alias("label"))
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    some = [r for v in (0, 1) for r in labels.where(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(per_class).collect()]
    chosen = docs.sparkSession.createDataFrame(some, labels.schema)  # at most 2 * per_class rows
    sample = (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
        .groupBy("key", "label").agg(F.min("text").alias("text"))
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            row, feature = features(part.column("text"))
            count = np.bincount(row, minlength=part.num_rows)
            sets = np.split(feature.astype("<u2"), np.cumsum(count)[:-1])
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["label", "features"])

    rows = sample.orderBy(F.xxhash64("key"), "key").select("label", "text").mapInArrow(
        extract, f"label {labels.schema['label'].dataType.simpleString()}, features binary").collect()
    good = np.array([r["label"] == 1 for r in rows], dtype=bool)
    x = [np.frombuffer(bytes(r["features"]), "<u2").astype(np.int64) for r in rows]
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    return train(x, good, (ones + 1) / (ones + zeros + 2))


def scores(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (null as empty); an input column ``out`` is replaced."""
    from pyspark.sql.functions import arrow_udf

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2 * DIMS numbers

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        got = [np.zeros(0)]
        for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], "text"):
            row, feature = features(part.column("text"))
            got.append(shared.value.score(row, feature, part.num_rows))
        return pa.array(np.concatenate(got))

    return docs.withColumn(out, score(F.col(text)))


def held_out(key: Column, parts: int = 5, rest: int = 0) -> Column:
    """Whether crc32 of the key as text leaves ``rest``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == rest, F.lit(False))
