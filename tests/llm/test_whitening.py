"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelweave.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def dense(rows, count=4):
    """(vec_id, deviation, projections) of the rows that stay, n, and the eigenvalues."""
    good = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    x = np.array([[math.floor(256 * c) for c in v] + [0] * (d - len(v)) for _, v in good], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    real = min(count, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    return [i for i, _ in good], ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes[:, :real] / np.sqrt(values[:real]), n, values


def check(rows, got):
    ids, deviation, projected, n, values = dense(rows)
    k = projected.shape[1]
    assert len(got) == len(ids) * k and {r.component for r in got} == set(range(1, k + 1))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    mine = {}
    for r in got:
        mine.setdefault((r.vec_id, r.component), []).append((r.deviation, r.whitened))
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10
    for j in range(k):
        of = {i: x for i, x in zip(ids, projected[:, j])}
        sign = np.sign(sum(of[i] * mine[i, j + 1][0][1] for i in of))
        for i, dev, x in zip(ids, deviation.tolist(), projected[:, j]):
            assert any(a == dev and abs(b - sign * x) < 1e-7 for a, b in mine[i, j + 1])


def table(d, n=300, seed=1, rank=None, spread=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, rank or d)) @ rng.normal(size=(rank or d, d)) if rank else rng.normal(size=(n, d)) * (spread or 1.3 ** -np.arange(d))
    return [(k, v, 1) for k, v in enumerate(x.tolist())]


@pytest.mark.parametrize("d, spread", [(8, None), (3, None), (1, None), (10, 0.05)])
def test_components(spark, d, spread):
    rows = table(d, spread=spread)
    check(rows, whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect())


def test_awkward_rows(spark):
    """Rows left out, repeated rows, a shorter vector, a null id, integer edges, clashing columns."""
    rows = table(6)
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 6, 1), (903, [float("inf")] * 6, 1), (904, rows[0][1], 2), (904, rows[0][1], 2), (905, rows[1][1][:4], 1),
             (906, [-0.0, 1 / 256, -1 / 512, 0.999999, 1e-30, -1e-30], 1), (None, rows[2][1], None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash")).withColumn("k", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    check(rows, whitening.whiten(df).collect())


def test_copies_count_once(spark):
    rows = table(5)
    many = rows + [(1000 + k, rows[0][1], 1) for k in range(500)]
    a = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    b = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(spark.createDataFrame(many, SCHEMA)).collect()}
    assert all(abs(b[k] - x) < 1e-9 for k, x in a.items()) and len(b) == len(a) + 4 * 500


def test_little_variance(spark):
    """Two directions only; one; none; no rows; no dimensions."""
    plane = [(k, [math.sin(k) * 3, math.cos(k * 1.7), 0.0, 0.0, 0.0], 1) for k in range(100)]
    assert {r.component for r in whitening.whiten(spark.createDataFrame(plane, SCHEMA)).collect()} == {1, 2}
    check(plane, whitening.whiten(spark.createDataFrame(plane, SCHEMA)).collect())
    line = [(k, [float(k % 7)] * 3, 1) for k in range(50)]
    check(line, whitening.whiten(spark.createDataFrame(line, SCHEMA)).collect())
    for rows in ([(k, [1.0, 2.0], 1) for k in range(5)], [(1, [1.0], 1)], [], [(1, [], 1)], [(1, None, 1)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_equal_eigenvalues(spark):
    """Every direction has the same variance: a new random vector goes on where the link vanishes."""
    rows = [(2 * j + s, [float((2 * s - 1) * (i == j)) for i in range(6)], 1) for j in range(6) for s in (0, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 12 * 4 and got[0].identity_error < 1e-9 and all(abs(r.explained - 1 / 6) < 1e-9 for r in got)
    found = {}
    for r in got:
        found.setdefault(r.component, {})[r.vec_id] = r.whitened
    gram = np.array([[sum(found[a][i] * found[b][i] for i in range(12)) for b in found] for a in found]) / 12
    assert np.abs(gram - np.eye(4)).max() < 1e-9


def test_a_larger_value_found_late(spark):
    """The largest of many directions has hardly any part in the first vector; all four leading ones are found."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 14)) * np.r_[np.full(10, 1.0), 6.0, 6.0, 6.0, 9.0]
    rows = [(k, v, 1) for k, v in enumerate(x.tolist())]
    check(rows, whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect())


def test_values_beyond_64_bits(spark):
    rows = [(1, [1e300, 0.0], 1), (2, [-1e300, 1.0], 1), (3, [0.5, 2.0], 1)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and all((r.deviation is None) == (r.vec_id < 3) for r in got)
