"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The rows are fixed to whole numbers, ``x = floor(256 c)``; each distinct row counts once, and X are these
rows less their mean.  From a random unit vector v, a step takes two distributed products:

    u_k = X v_k less its parts along u_1 ... u_(k-1), of length alpha_k
    w   = X'u_k - alpha_k v_k less its parts along v_1 ... v_k, of length beta_k;  v_(k+1) = w / beta_k

The u are as long as the table, so they are not kept: u_j = X y_j with a short y_j, and a task makes them
for its own rows again.  Parts are taken off twice, on both sides.  The v and y, the small bidiagonal
matrix and its SVD are the driver's: numbers by dimensions and steps, never by rows.  The singular values
over sqrt(n) are the deviations, the right vectors turned by the SVD the components.

A step ends the search when the residuals of the leading components have reached the rounding error and
either no direction is left, or all that is left could not hold a larger one, or as many further steps have
changed nothing.  Where alpha or beta vanishes (directions without variance, equal eigenvalues), a new
random vector goes on.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out; a null vec_id
is kept; a shorter vector counts as filled up with zeros; values beyond 64 bits saturate, and a deviation
beyond them is null.  Components without variance have no rows, so an empty table, equal rows only, or empty
vectors give an empty result.  With equal eigenvalues the components are some basis, the same for all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import stage

SCALE = 256
COMPONENTS = 4
SEED = 20
#: rows that a task multiplies at a time
ROWS = 8192


def fixed(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and the whole-number vector x of every row whose vector has only finite entries."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "v IS NOT NULL AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) <> double('infinity'))")
    return good.select("vec_id", F.expr(f"transform(v, c -> floor({scale}D * c))").alias("x"))


def _blocks(batches, column: str):
    """(batch, rows x dimensions) pieces of a list column of one length."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            lists = piece.column(piece.schema.get_field_index(column))
            yield piece, np.asarray(lists.flatten()).reshape(piece.num_rows, -1)


def _summed(fit: DataFrame, work, kind: str = "double") -> list:
    """Sums over all tasks of the numbers ``work(blocks)`` returns, in order."""

    def run(batches):
        total = work(x for _, x in _blocks(batches, "x"))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.float64() if kind == "double" else pa.decimal128(38, 0))], ["k", "s"])

    rows = fit.select("x").mapInArrow(run, f"k int, s {kind}").groupBy("k").agg(F.sum("s").alias("s")).collect()
    return [r.s for r in sorted(rows)]


def _counts(blocks):
    """Number of rows and exact sums of the dimensions."""
    total = None
    for x in blocks:
        exact = x if np.abs(x.astype(float)).max(initial=0) * len(x) < 2.0**62 else x.astype(object)
        now = [len(x), *(int(s) for s in exact.sum(axis=0))]
        total = now if total is None else [a + b for a, b in zip(total, now)]
    return total


def _added(total, now):
    return now if total is None else total + now


class Bidiagonal:
    """The state of the bidiagonalisation of a centred table; ``step`` adds a column."""

    def __init__(self, fit: DataFrame, mean: np.ndarray, seed: int = SEED):
        self.fit, self.mean = fit, mean
        self.d = len(mean)
        self.random = np.random.default_rng(seed)
        self.v = np.zeros((self.d, 0))  # right vectors
        self.y = np.zeros((self.d, 0))  # left vectors are X y
        self.z = np.zeros((self.d, 0))  # X' times the left vectors
        self.b = np.zeros((0, 0))  # left by right
        self.link = 0.0  # beta to the next right vector
        self.scale = 0.0

    def _fresh(self, w: np.ndarray | None) -> tuple[np.ndarray, float]:
        """The next right vector, orthogonal to all others, and its beta; 0 with a new random one."""
        if w is not None:
            for _ in range(2):
                w = w - self.v @ (self.v.T @ w)
            size = float(np.linalg.norm(w))
            if size > self._least():
                return w / size, size
        w = self.random.normal(size=self.d)
        for _ in range(3):
            w = w - self.v @ (self.v.T @ w)
            w /= np.linalg.norm(w)
        return w, 0.0

    def _least(self) -> float:
        return 8 * np.finfo(float).eps * max(self.d, 64) * self.scale

    def step(self) -> None:
        k, mean, y = self.v.shape[1], self.mean, self.y
        w = self.z[:, -1] - self.b[-1, -1] * self.v[:, -1] if k and self.b.shape[0] and self.b[-1, -1] else None
        v, self.link = self._fresh(w)

        def along(blocks):
            total = None
            for x in blocks:
                c = x - mean
                p = c @ v
                total = _added(total, np.append((c @ y).T @ p, p @ p))
            return total

        *parts, square = _summed(self.fit, along)
        self.scale = max(self.scale, square**0.5)
        first = v - y @ np.array(parts) if parts else v

        def back(blocks):
            total = None
            for x in blocks:
                c = x - mean
                u = c @ first
                total = _added(total, np.concatenate([c.T @ u, (c @ y).T @ u, [u @ u]]))
            return total

        found = np.array(_summed(self.fit, back))
        z, again, square = found[: self.d], found[self.d : -1], max(0.0, found[-1])
        z, first = z - self.z @ again, first - y @ again  # the parts that rounding left
        alpha = max(0.0, square - float(again @ again)) ** 0.5
        rows = self.b.shape[0]
        grown = np.zeros((rows + 1, k + 1))
        grown[:rows, :k] = self.b
        if self.link:
            grown[rows - 1, k] = self.link
        self.v = np.column_stack([self.v, v])
        if alpha > self._least():
            grown[rows, k] = alpha
            self.y, self.z = np.column_stack([y, first / alpha]), np.column_stack([self.z, z / alpha])
            self.b = grown
        else:  # X v lies along the left vectors so far
            self.b = grown[:rows]

    def leading(self, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Singular values and right vectors that come first, their residuals, and the squares of all values."""
        if not self.b.shape[0]:
            return np.zeros(0), np.zeros((self.d, 0)), np.zeros(0), 0.0
        left, s, right = np.linalg.svd(self.b, full_matrices=False)
        ahead = 0.0
        if self.b[-1, -1]:
            w = self.z[:, -1] - self.b[-1, -1] * self.v[:, -1]
            ahead = float(np.linalg.norm(w - self.v @ (self.v.T @ w)))
        return s[:count], self.v @ right[:count].T, ahead * np.abs(left[-1, :count]), float(s @ s)


def components(fit: DataFrame, mean: np.ndarray, spread: float, count: int = COMPONENTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Falling singular values of the centred rows, those above the rounding error, and their right vectors, as columns."""
    work, steady, before = Bidiagonal(fit, mean, seed), 0, None
    count = min(count, work.d)
    while work.v.shape[1] < work.d:
        work.step()
        s, vectors, rest, seen = work.leading(count)
        k = work.v.shape[1]
        if len(s) < count or rest.max() > np.finfo(float).eps * s[0] or before is not None and np.abs(s - before).max() > 1e-13 * s[0]:
            steady, before = k, s if len(s) == count else None
            continue
        before = s
        if spread - seen < s[-1] ** 2 * (1 - 1e-9) or k >= 2 * steady:
            break
    s, vectors, _, _ = work.leading(count)
    real = s > np.finfo(float).eps * work.d * s[0] * 8 if len(s) else np.zeros(0, bool)
    vectors = vectors[:, real]
    if vectors.shape[1]:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return s[real], vectors


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, count: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component."""
    spark = vectors.sparkSession
    rows = fixed(vectors, scale)
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        return spark.createDataFrame([], RESULT)
    rows = stage(rows.select("vec_id", F.expr(f"CASE WHEN size(x) < {d} THEN concat(x, array_repeat(0L, {d} - size(x))) ELSE x END").alias("x")), "whiten-rows")
    fit = stage(rows.select("x").distinct(), "whiten-fit")
    n, *sums = (int(s) for s in _summed(fit, _counts, "decimal(38,0)"))
    mean = np.array([s / n for s in sums])

    def squares(blocks):
        total = None
        for x in blocks:
            total = _added(total, np.array([((x - mean) ** 2).sum()]))
        return total

    spread = _summed(fit, squares)[0]
    s, axes = components(fit, mean, spread, count, seed) if spread > 0 else (np.zeros(0), np.zeros((d, 0)))
    k = len(s)
    if not k:
        return spark.createDataFrame([], RESULT)
    turn = axes / (s / n**0.5)

    def moments(blocks):
        total = None
        for x in blocks:
            w = (x - mean) @ turn
            total = _added(total, np.concatenate([w.sum(axis=0), (w.T @ w).ravel()]))
        return total

    found = np.array(_summed(fit, moments)) / n
    identity_error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
    explained = s**2 / spread
    whole = np.array(sums, object)
    bound = max(map(abs, sums))

    def project(batches):
        for piece, x in _blocks(batches, "x"):
            w = (x - mean) @ turn
            if d * (n * float(np.abs(x.astype(float)).max(initial=0)) + bound) ** 2 < 2.0**62:
                deviation = ((n * x - whole.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [t if t < 1 << 63 else None for t in ((n * x.astype(object) - whole) ** 2).sum(axis=1).tolist()]
            m = piece.num_rows
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                 pa.array([t for t in deviation for _ in range(k)], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, RESULT)
