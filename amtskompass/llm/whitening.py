"""Whitening of embeddings by spectral divide and conquer.

Sums and the centred covariance are gathered by Spark: every task gives one matrix, which is added up by element.  The
covariance (as wide as a vector, whatever the number of rows) is split on the driver: the polar factor of the
covariance minus a shift, found by dynamically weighted Halley iteration (QDWH), is +1 on the invariant subspace above the
shift and -1 below it, so half its sum with the identity is a spectral projector.  Bases of the projector's range and
null space cut the problem in two, and the parts are cut again until they are single components.  The components go
to all tasks, which project their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, usable

OFFSET = 100_000
EPS = np.finfo(np.float64).eps
LONGS = 2.0**63


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH: cubic convergence, at most six or seven rounds.

    A round is one QR factorisation, or a Cholesky factorisation once the matrix is well conditioned.
    """
    n = len(a)
    x = a / np.linalg.norm(a, 1)  # all singular values are at most 1
    low = EPS  # and at least this, unless the matrix is singular to working precision
    one = np.eye(n)
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.concatenate((np.sqrt(wc) * x, one)))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            lower = np.linalg.cholesky(one + wc * (x.T @ x))
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if 1 - low < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if all eigenvalues are equal.

    The mean of the diagonal lies strictly between the smallest and the largest eigenvalue, so a shift near it always splits.
    """
    n = len(a)
    diagonal = np.diag(a)
    mean = diagonal.mean()
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    size = np.linalg.norm(a)
    if spread <= 4 * EPS * size:
        return None
    best = None
    for shift in (np.median(diagonal), mean, mean + spread / 8, mean - spread / 8, mean + spread / 3, mean - spread / 3):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(float(np.trace(projector))))
        if not 0 < k < n:
            continue
        q, _ = np.linalg.qr(projector @ np.random.default_rng(7).standard_normal((n, n)))
        q, _ = np.linalg.qr(np.concatenate((projector @ q[:, :k], q[:, k:]), axis=1))
        off = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or off < best[0]:
            best = off, q[:, :k], q[:, k:]
        if off <= 16 * n * EPS * size:
            break
    return None if best is None else best[1:]


def components(a: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``first`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    n = len(a)
    if n <= 1:
        return np.diag(a).copy(), np.eye(n)
    parts = halves(a)
    if parts is None:  # all directions are alike: any basis will do
        return np.full(n, np.diag(a).mean()), np.eye(n)
    values, vectors = [], []
    for basis in parts:
        if sum(map(len, values)) < first:
            inner = basis.T @ a @ basis
            _, own = components((inner + inner.T) / 2, first - sum(map(len, values)))
            vectors.append(basis @ own)
            values.append(np.einsum("ij,ij->j", vectors[-1], a @ vectors[-1]))
    value, vector = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-value, kind="stable")[:first]
    vector = vector[:, order]
    return value[order], vector / np.linalg.norm(vector, axis=0)


def _added(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int, kind: str) -> np.ndarray:
    """Sum over all rows of ``of(matrix)``, which gives one flat array of fixed length for each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(matrix(batch.column("x"), width, OFFSET))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": np.arange(len(total)), "value": total})

    sums = rows.select("x").mapInArrow(run, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(sums.num_rows, dtype=np.int64 if kind == "long" else np.float64)
    out[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    return out


def _both(x: np.ndarray) -> np.ndarray:
    """Rows, sums and the scatter of projected rows about zero, flat."""
    return np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))


def whitened(rows: DataFrame, first: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    A vector's entries become ``floor(1024 * c) + 100000``.  Rows whose vector is null or holds a null or non-finite entry are
    left out; a row without an id stays, repeated rows count as often as they stand, a vector that is shorter than another is
    continued by zeros, and other columns are not read.  ``deviation`` is null where it does not fit a long.  Components whose
    eigenvalue is zero to working precision have no whitened value and are left out, so equal vectors, a single one, or an empty
    table give no rows.  The sign of a component makes its largest entry positive.
    """
    spark = rows.sparkSession
    fit = usable(rows, key, vector, OFFSET)
    nothing = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    facts = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = facts["n"], facts["width"]
    if not n or not width:
        return nothing
    sums = _added(fit, lambda x: x.sum(axis=0), width, "long")

    def centred(x: np.ndarray) -> np.ndarray:  # exact before the division where the products fit a long
        return (x * n - sums) / n if n * 4e5 < LONGS and abs(sums).max() < LONGS / 2 and abs(x).max(initial=0) < LONGS / 4 / n else x - sums / n

    def scatter(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        return (c.T @ c).ravel()

    covariance = _added(fit, scatter, width, "double").reshape(width, width) / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    value, basis = components(covariance, first)
    real = value > width * EPS * max(trace, 0.0)
    value, basis = value[real], basis[:, real]
    if not len(value):
        return nothing
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(value))])
    scaled = basis / np.sqrt(value)
    moments = _added(fit, lambda x: _both(centred(x) @ scaled), width, "double")
    k = len(value)
    mean = moments[1 : k + 1] / n
    measured = moments[k + 1 :].reshape(k, k) / n - np.outer(mean, mean)
    error = float(np.abs(measured - np.eye(k)).max())

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width, OFFSET)
            rows = len(x)
            far = centred(x)
            away = x * n - sums
            fits = (far * n) ** 2 @ np.ones(width) < LONGS * 0.999
            deviation = pa.array((away * away).sum(axis=1), mask=~fits)
            at = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("id").take(pa.array(at)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * k, n, dtype=np.int64)),
                    "deviation": deviation.take(pa.array(at)),
                    "whitened": (far @ scaled).ravel(),
                    "explained": np.tile(value / trace, rows),
                    "identity_error": np.full(rows * k, error),
                }
            )

    return fit.mapInArrow(project, nothing.schema)
