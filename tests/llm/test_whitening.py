import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from blotter.llm import whitening
from tables import table

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                     T.StructField("x", T.StringType()), T.StructField("n", T.LongType())])  # clashing names


def expected(rows, k=4):
    """numpy's own eigenvectors over the distinct integer vectors; (x, n, sums, values, vectors, trace)."""
    x = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, dim = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(dim)]
    y = np.array([[n * v[i] - sums[i] for i in range(dim)] for v in fit], np.float64) / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    return x, n, sums, values[::-1][:k], vectors[:, ::-1][:, :k], np.trace(cov)


def check(got, rows, k=4):
    x, n, sums, values, vectors, trace = expected(rows, k)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(x)
    sign = None
    for i, own in by.items():
        deviation = sum((n * c - s) ** 2 for c, s in zip(x[i], sums))
        own = sorted(own, key=lambda r: r.component)[:k]
        assert [r.component for r in own] == list(range(1, k + 1))
        assert all(r.n == n and r.deviation == (deviation if deviation < 2**63 else None) for r in own)
        assert all(r.explained == pytest.approx(v / trace, rel=1e-9) and r.identity_error < 1e-9 for r, v in zip(own, values))
        want = (np.array(x[i]) - np.array(sums) / n) @ vectors / np.sqrt(values)
        have = np.array([r.whitened for r in own])
        if sign is None:
            sign = np.sign(want * have)
        assert np.allclose(have * sign, want, atol=1e-7)


def test_whole_table_equals_numpy(spark):
    df = table(spark, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check(whitening.whiten(df).collect(), rows)


def test_odd_rows(spark):
    rng = random.Random(1)
    good = [(i, [rng.gauss(3, 1), rng.gauss(-2, 5), rng.gauss(0, 0.1), rng.gauss(1000, 2), rng.gauss(0, 1)]) for i in range(300)]
    good += [(300 + i, good[7][1]) for i in range(150)]  # a third are one vector: once in the fit list
    bad = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], ROWS)
    check(whitening.whiten(df).collect(), good)
    twice = df.where("vec_id = 3").union(df)
    rows = whitening.whiten(twice).where("vec_id = 3").collect()
    assert len(rows) == 8  # repeated rows stay
    assert whitening.whiten(spark.createDataFrame([(None, v, "x", 1) for _, v in good], ROWS)).where("vec_id IS NULL").count() == 4 * len(good)


def test_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "", 1), (2, [1.0, 2.0], "", 1)], ROWS)
    got = whitening.whiten(df).collect()
    assert len(got) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], "", 1) for i in range(5)], ROWS)
    got = whitening.whiten(line).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got)
    assert all(r.explained == pytest.approx(2 - r.component, abs=1e-12) and r.identity_error < 1e-9 for r in got)
    assert whitening.whiten(spark.createDataFrame([], ROWS)).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [2.0 ** 40 + 2.0 ** 18 * i, -(2.0 ** 41) + 2.0 ** 18 * (i * i % 7)]) for i in range(40)]
    df = spark.createDataFrame([(*r, "", 1) for r in rows], ROWS)
    check(whitening.whiten(df).collect(), rows, k=2)
    far = spark.createDataFrame([(1, [1e30, -1e30], "", 1), (2, [0.0, 0.0], "", 1)], ROWS)
    assert {r.deviation for r in whitening.whiten(far).collect()} == {None}


def test_components_of_hard_matrices():
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    spectra = [np.linspace(-1, 1, 24), np.logspace(0, -15, 24), np.r_[np.full(12, 5.0), np.ones(12)], np.r_[1e6, np.linspace(1, 1 + 1e-9, 23)],
               np.r_[np.ones(23), 1 + 1e-13], np.zeros(24)]
    for spectrum in spectra:
        a = basis @ np.diag(spectrum) @ basis.T
        a = (a + a.T) / 2
        values, vectors = whitening.eigen(a)
        size = max(np.linalg.norm(a, 2), 1e-300)
        assert np.abs(values - np.sort(spectrum)[::-1]).max() <= 1e-13 * size
        assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-13 * size
        assert np.linalg.norm(vectors.T @ vectors - np.eye(24)) < 1e-13


def test_polar_factor_of_known_matrix():
    basis = np.linalg.qr(np.random.default_rng(3).standard_normal((10, 10)))[0]
    spectrum = np.array([3, 1, 1e-3, 1e-9, 2, -1, -5, -1e-6, -1e-2, -4.0])
    u = whitening.polar(basis @ np.diag(spectrum) @ basis.T)
    assert np.allclose(u, basis @ np.diag(np.sign(spectrum)) @ basis.T, atol=1e-6)
