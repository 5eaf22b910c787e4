"""Embedding whitening: components by spectral divide and conquer with QDWH polar decompositions.

1. **Integers.** Each entry c becomes x = floor(256 * c), so counts, sums and products are exact and no result
   depends on how rows are dealt. The fit list holds each distinct x-vector once (written once, read by each pass).
2. **Covariance.** A first pass sums each dimension. A second multiplies the vectors centred at the nearest whole numbers of
   the means, exactly, block by block; what the centring leaves over is taken off in rational arithmetic. Tasks
   return one row for each pair of dimensions, summed by Spark, so only dim * (dim + 1) / 2 numbers reach the driver.
3. **Components.** The matrix (dim x dim, a size that does not grow with the data) is split: the unitary polar
   factor U of A - shift * I has eigenvalue +1 where A's lies above the shift and -1 below, so (U + I) / 2 projects on an invariant
   subspace. Its basis and that of its complement turn A into two blocks, each split in turn, until a block has size one or
   is a multiple of the identity. U comes from dynamically weighted Halley iterations (QDWH) with QR steps, which are stable however near
   an eigenvalue lies to the shift.
4. **Whitening.** The first components over the roots of their eigenvalues go to all tasks and are applied to every row.
   A last pass measures the covariance of the whitened fit list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stage

SCALE, COMPONENTS, BLOCK_ROWS = 256, 4, 4096
EPS = float(np.finfo(float).eps)


# --- spectral divide and conquer -----------------------------------------------------------------
def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix, by QDWH iterations.

    ``low`` bounds the least singular value of the scaled iterate from below; the weights of each step are the
    best ones for the interval [low, 1], which maps it to a shorter one. Directions whose singular value is below
    rounding may end anywhere between -1 and 1; the caller looks at the result.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    low = EPS / 4
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        p = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.concatenate((np.sqrt(r) * x, np.eye(n))))
        new = q / r * x + (p - q / r) / np.sqrt(r) * (both[:n] @ both[n:].T)
        new = (new + new.T) / 2
        step, x = np.linalg.norm(new - x), new
        low = min(low * (p + q * square) / (1 + r * square), 1 - EPS)
        if low > 1 - 4 * EPS and step < n * 1e-14:
            break
    return x


def _halves(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """(orthogonal basis, rank): its first columns span the invariant subspace above a shift, the rest that below."""
    n = len(a)
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.trace(a) / n * np.eye(n))
    middle = (diagonal[(n - 1) // 2] + diagonal[n // 2]) / 2
    # An eigenvalue at the shift would leave the projector undecided: then another shift is taken.
    for off in (0.0, 0.013, -0.017, 0.071, -0.083, 0.19, -0.23, 0.41, -0.47):
        u = polar(a - (middle + off * spread / np.sqrt(n)) * np.eye(n))
        if np.linalg.norm(u @ u - np.eye(n)) > 1e-10 * n:
            continue
        rank = round((np.trace(u) + n) / 2)
        if 0 < rank < n:
            projector = (u + np.eye(n)) / 2
            start = np.linalg.qr(np.random.default_rng(n).standard_normal((n, rank)))[0]
            basis = np.linalg.qr(projector @ start)[0]
            return np.linalg.qr(projector @ basis, mode="complete")[0], rank
    return None


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; their unit eigenvectors as columns) of a symmetric matrix, largest entry positive."""
    n = len(a)
    values, vectors = np.zeros(n), np.eye(n)
    least = n * EPS * np.linalg.norm(a)
    todo = [(0, n, a)]
    while todo:
        at, size, block = todo.pop()
        if size == 0:
            continue
        flat = np.linalg.norm(block - np.diag(np.diag(block))) <= least
        split = None if size == 1 or flat else _halves(block)
        if split is None:
            if not flat and size > 1:  # eigenvalues too near each other for any shift between them
                vectors[:, at:at + size], block = _rotate(vectors[:, at:at + size], block)
            values[at:at + size] = np.diag(block)
            continue
        basis, rank = split
        vectors[:, at:at + size] = vectors[:, at:at + size] @ basis
        block = basis.T @ block @ basis
        block = (block + block.T) / 2
        todo += [(at, rank, block[:rank, :rank]), (at + rank, size - rank, block[rank:, rank:])]
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)]) if n else np.zeros(0)
    return values, vectors * np.where(sign == 0, 1, sign)


def _rotate(vectors: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plane rotations until a nearly scalar block is diagonal."""
    block, n = block.copy(), len(block)
    for _ in range(30):
        if np.linalg.norm(block - np.diag(np.diag(block))) <= EPS * np.linalg.norm(block):
            break
        for i in range(n):
            for j in range(i + 1, n):
                angle = np.arctan2(2 * block[i, j], block[i, i] - block[j, j]) / 2
                turn = np.eye(n)
                turn[i, i] = turn[j, j] = np.cos(angle)
                turn[j, i], turn[i, j] = np.sin(angle), -np.sin(angle)
                block, vectors = turn.T @ block @ turn, vectors @ turn
    return vectors, block


# --- passes over the rows ------------------------------------------------------------------------
def integer_rows(rows: DataFrame, vector: str = "embedding", out: str = "x") -> DataFrame:
    """``rows`` with ``out`` (array of long) in the vector's place: floor(256 * c) of each entry c.

    Rows whose vector is null or empty, or holds null or non-finite entries, are dropped, and so are those of another length
    than the most common one (of equally common lengths the larger counts). Entries beyond a long become the nearest long.
    """
    vec = F.col(vector).cast("array<double>")
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    clean = rows.where(vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)))
    lengths = clean.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    clean = clean.where(F.size(vector) == (lengths["dim"] if lengths else 0))
    rest = [c for c in rows.columns if c not in (vector, out)]
    return clean.select(*rest, F.transform(vec, lambda c: F.floor(c * SCALE).cast("long")).alias(out))


def _blocks(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[np.ndarray]:
    """The column's vectors as integer matrices of at most ``BLOCK_ROWS`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.column(column).slice(at, BLOCK_ROWS)
            yield part.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(part), -1)


def gram(y: np.ndarray) -> np.ndarray:
    """The products y.T @ y, exact: in doubles where all sums stay whole, else in Python's integers."""
    top = max(int(y.max(initial=0)), -int(y.min(initial=0)))
    if top * top * max(len(y), 1) < 1 << 53:
        d = y.astype(np.float64)
        return (d.T @ d).astype(np.int64).astype(object)
    return y.astype(object).T @ y.astype(object)


def _minus(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x - centre as 64-bit integers, or Python's where these are too short."""
    far = max([0, *map(abs, centre)])
    if far < 1 << 62 and (not x.size or max(int(x.max()), -int(x.min())) < 1 << 62):
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


@dataclass
class Whitening:
    """What the fit list gives: its size, sums, eigenvalues and components (columns), and the measured error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float | None = None

    @property
    def usable(self) -> np.ndarray:
        """Components with a variance above rounding."""
        return self.values > len(self.sums) * EPS * abs(self.trace)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, whole parts taken off before rounding."""
        centre = [s // self.n for s in self.sums]
        left = np.array([(s - c * self.n) / self.n for s, c in zip(self.sums, centre)])
        return _minus(x, centre).astype(np.float64) - left

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """Projections on the first components over the roots of their eigenvalues; NaN where there is no variance."""
        root = np.sqrt(np.where(self.usable, self.values, np.nan))[:components]
        return self.centred(x) @ self.vectors[:, :components] / root

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)^2, exact; None beyond a long."""
        centre = [s // self.n for s in self.sums]
        y, left = _minus(x, centre), [s - c * self.n for s, c in zip(self.sums, centre)]
        top = max(int(y.max(initial=0)), -int(y.min(initial=0))) * self.n + self.n
        if top * top * max(y.shape[1], 1) < 1 << 63:
            d = y.astype(np.int64) * self.n - np.array(left, np.int64)
            return (d * d).sum(axis=1).tolist()
        d = y.astype(object) * self.n - np.array(left, object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(axis=1).tolist()]


def covariance(fitted: DataFrame) -> tuple[int, list[int], list[list[Fraction]]]:
    """(size, sums, covariance with divisor n) of the distinct x-vectors of ``fitted`` (x), exact."""
    total = fitted.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim")).first()
    n, dim = total["n"], total["dim"] or 0
    if not n:
        return 0, [], []
    sums = [int(s) for s in fitted.agg(*[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]).first()]
    centre = [round(Fraction(s, n)) for s in sums]
    at, to = np.triu_indices(dim)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for x in _blocks(batches):
            total = total + gram(_minus(x, centre))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(to, pa.int32()), pa.array([str(v) for v in total[at, to]], pa.string())],
            names=["i", "j", "v"])

    found = fitted.select("x").mapInArrow(products, "i int, j int, v string").groupBy("i", "j").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    left = [s - n * c for s, c in zip(sums, centre)]  # what the whole-number centring leaves over
    v = [[Fraction(0)] * dim for _ in range(dim)]
    for r in found.collect():
        v[r.i][r.j] = v[r.j][r.i] = (n * Fraction(int(r.v)) - left[r.i] * left[r.j]) / (n * n)
    return n, sums, v


def _identity_error(fitted: DataFrame, model: Whitening, components: int) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    usable = np.flatnonzero(model.usable[:components])
    if not len(usable):
        return None
    k = len(usable)
    names = [f"w{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches):
            w = model.whitened(x, components)[:, usable]
            sums, products = sums + w.sum(axis=0), products + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([r]) for r in np.concatenate((sums, products.ravel()))],
                                         names=[*names, *(f"p{i}" for i in range(k * k))])

    schema = ", ".join(f"{c} double" for c in [*names, *(f"p{i}" for i in range(k * k))])
    got = np.array(fitted.select("x").mapInArrow(run, schema).groupBy().sum().first(), np.float64) / model.n
    mean, second = got[:k], got[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def fit(fitted: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct x-vectors of ``fitted`` (x), its identity error measured."""
    n, sums, exact = covariance(fitted)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    v = np.array([[float(c) for c in row] for row in exact])
    values, vectors = eigen(v)
    model = Whitening(n, sums, values, vectors, float(sum(exact[i][i] for i in range(len(sums)))))
    model.error = _identity_error(fitted, model, components)
    return model


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): each row and each of the first components.

    Components are numbered from 1 by falling eigenvalue; there are at most as many as dimensions. Rows dropped are those of
    ``integer_rows``; equal rows and null keys stay, other columns are left out. A component without variance has a
    null ``whitened``; without any variance ``explained`` and ``identity_error`` are null. An empty table gives no rows.
    """
    clean = integer_rows(rows.select(F.col(key).alias("key"), F.col(vector).alias("v")), "v")
    clean = stage(clean, "whiten-rows")
    fitted = stage(clean.select("x").distinct(), "whiten-fit")
    model = fit(fitted, components)
    kind = clean.schema["key"].dataType.simpleString()
    k = min(components, len(model.sums))
    share = [None if model.trace <= 0 else max(float(e), 0.0) / model.trace for e in model.values[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = next(_blocks([part]))
                m = len(x)
                each = np.repeat(np.arange(m), k)
                w = model.whitened(x, k).ravel()
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                     pa.array(np.full(m * k, model.n)), pa.array(model.deviation(x), pa.int64()).take(pa.array(each)),
                     pa.array(w, mask=np.isnan(w)), pa.array(share * m, pa.float64()),
                     pa.array([model.error] * (m * k), pa.float64())],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return clean.mapInArrow(run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, "
                                 "identity_error double")
