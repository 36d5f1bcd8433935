from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from casefile.llm import whitening
from casefile.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def expected(vectors):
    """Whole vectors, the fit list, eigenvalues and vectors of its covariance by numpy."""
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, fit, values[::-1], axes[:, ::-1]


def check(rows, ids, vectors, tolerance=1e-8):
    x, fit, values, axes = expected(vectors)
    n, sums, d = len(fit), fit.sum(axis=0), x.shape[1]
    count = min(16, d)
    assert len(rows) == len(vectors) * count and {r.n for r in rows} == {n}
    by = {(r.vec_id, r.component): r for r in rows}
    for i, v in zip(ids, x):
        assert by[i, 1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))
    for k in range(1, count + 1):
        got = np.array([by[i, k].whitened for i in ids])
        want = (x - sums / n) @ axes[:, k - 1] / math.sqrt(values[k - 1])
        sign = 1 if abs(got - want).max() < abs(got + want).max() else -1
        assert abs(sign * got - want).max() < tolerance
        assert abs(by[ids[0], k].explained / (values[k - 1] / values.sum()) - 1) < 1e-9
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_query(spark):
    table = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()
    rows = QUERIES["op12_whitening"](spark, FOLDER).collect()
    check(rows, [r["vec_id"] for r in table], [r["embedding"] for r in table])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n string").repartition(3)


def test_odd_rows(spark):
    draw = random.Random(8)
    good = [(i, [draw.gauss(0, 1 + k) for k in range(5)]) for i in range(40)]
    good += [(i + 100, v) for i, v in good[:10]]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [1.0, math.nan, 2.0, 3.0, 4.0]), (204, [math.inf] * 5), (205, [1.0] * 3), (206, [1e30] * 5)]
    rows = whitening.whiten(frame(spark, good + bad)).collect()
    check(rows, [i for i, _ in good], [np.float32(v) for _, v in good])
    assert whitening.whiten(frame(spark, bad[:1])).collect() == []
    assert whitening.whiten(frame(spark, good).limit(0)).collect() == []


def test_no_variance(spark):
    """Fewer directions than components: the rest have no whitened values; one vector alone has none at all."""
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(4)]
    rows = whitening.whiten(frame(spark, line)).collect()
    assert sorted({(r.component, r.whitened is None, r.explained) for r in rows}) == [(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)]
    assert rows[0].identity_error < 1e-9
    rows = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(rows) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(1, 0, None, None, None)}


def test_equal_roots(spark):
    """A cross in four dimensions: every eigenvalue is the same."""
    rows = whitening.whiten(frame(spark, [(2 * k + s, [(1.0 if s else -1.0) * (j == k) for j in range(4)]) for k in range(4) for s in (0, 1)])).collect()
    white = np.zeros((8, 4))
    for r in rows:
        white[r.vec_id, r.component - 1] = r.whitened
    assert abs(white.T @ white / 8 - np.eye(4)).max() < 1e-12 and {r.explained for r in rows} == {0.25}


@pytest.mark.parametrize("d", [1, 2, 5, 9])
def test_polynomial(spark, d):
    """Against the recurrence of Faddeev and LeVerrier in fractions; the roots against their counts."""
    draw = random.Random(d)
    a = np.array([[draw.randrange(-9, 10) * 10**6 for _ in range(d)] for _ in range(d)], dtype=object)
    if d == 9:
        a[3] = a[4]  # a root zero
    m = a @ a.T
    want, b = [Fraction(1)], np.array([[Fraction(0)] * d] * d, dtype=object)
    for k in range(1, d + 1):
        b = m @ b + want[-1] * np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], dtype=object)
        want.append(-sum((m @ b)[i, i] for i in range(d)) / k)
    coefficients = whitening.characteristic(spark, m)
    assert coefficients == [int(c) for c in reversed(want)]
    roots, shift = whitening.greatest_roots(coefficients, int(np.trace(m)), d)
    values = sorted(np.linalg.eigvalsh(m.astype(float)), reverse=True)
    assert all(abs(r / 2**shift - v) < 1e-9 * values[0] + 1 for r, v in zip(roots, values))
    for r in set(roots):
        scaled = [c << (shift * (d - i)) for i, c in enumerate(coefficients)]
        assert whitening.roots_above(scaled, r) < 1 + roots.index(r) <= whitening.roots_above(scaled, r - 1)


def test_long_entries(spark):
    """Products beyond doubles and deviations beyond a long."""
    draw = random.Random(9)
    rows = whitening.whiten(spark.createDataFrame([(i, [draw.uniform(-3e9, 3e9), draw.uniform(-1, 1)]) for i in range(30)], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in rows} == {None} and rows[0].identity_error < 1e-6
