"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries are whole numbers (scaled and floored), so the scatter of the distinct vectors is an integer matrix, summed
exactly over the cluster. Its characteristic polynomial is found modulo many primes by Hessenberg reduction, one prime a
row of a Spark job, and put together by Chinese remaindering. All its roots are real, so sign changes of a shifted
polynomial count the roots above any point exactly; the greatest roots are isolated that way and refined to ``BITS`` bits.
Inverse iteration in the null space of matrix - root, in long decimals, one root a row of a job, gives the components.

What is held at once depends on the dimension only: the matrix, its polynomial, and ``MOST`` components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.llm.common import stored

SCALE, OFFSET, MOST = 64, 1_000_000, 16
BITS = 160
"""Bits to which roots are refined, counted from the greatest."""
LARGEST = 1 << 40
"""Entries x of vectors that take part are below this in size."""
ROWS = 1 << 12
SMALL = 1 << 20
"""Entries up to which the products of ``ROWS`` rows add up exactly in doubles."""


# -- the fit list and its scatter --------------------------------------------------------------------------------------


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, x array<bigint>): x = floor(``SCALE`` * entry) + ``OFFSET``. Rows without a usable vector go."""
    entry = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST / SCALE))
    return vectors.select(F.col(key).alias("vec_id"), F.when(F.col(vector).isNotNull() & (F.size(vector) > 0) & usable, entry).alias("x")).filter("x is not null")


def matrix_of(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of x - ``OFFSET``."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) - OFFSET


def totals(fit: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, sums of products) of x - ``OFFSET`` over ``fit`` (x), as Python's whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = matrix_of(batch.column(0).slice(at, ROWS))
                if np.abs(y).max(initial=0) < SMALL:
                    square = (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64).astype(object)
                else:
                    square = y.astype(object).T @ y.astype(object)
                n += len(y)
                added = y.astype(object).sum(axis=0) if np.abs(y).max(initial=0) >= SMALL else y.sum(axis=0).astype(object)
                sums = added if sums is None else sums + added
                products = square if products is None else products + square
        if n:
            d = len(sums)
            upper = [(i, j) for i in range(d) for j in range(i, d)]
            where = [(-1, -1), *((-1, i) for i in range(d)), *upper]
            value = [n, *sums, *(products[i, j] for i, j in upper)]
            columns = [pa.array([i for i, _ in where], pa.int32()), pa.array([j for _, j in where], pa.int32()), pa.array([Decimal(int(v)) for v in value], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "value"])

    found = fit.select("x").mapInArrow(run, "i int, j int, value decimal(38,0)").groupBy("i", "j").agg(F.sum("value").cast("string").alias("value"))
    cells = {(r.i, r.j): int(r.value) for r in found.collect()}  # as many as the dimension's square
    if not cells:
        return 0, np.empty(0, dtype=object), np.empty((0, 0), dtype=object)
    d = 1 + max(j for _, j in cells)
    products = np.empty((d, d), dtype=object)
    for i in range(d):
        for j in range(i, d):
            products[i, j] = products[j, i] = cells[i, j]
    return cells[-1, -1], np.array([cells[-1, i] for i in range(d)], dtype=object), products


# -- the polynomial ----------------------------------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """For n below 2 ** 31, by the bases 2, 3, 5, 7."""
    if n < 11 or n % 2 == 0:
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """The greatest primes below 2 ** 31 whose product has more than ``bits`` bits."""
    out, product, n = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits + 1:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A Hessenberg matrix modulo ``p`` (below 2 ** 31) with the characteristic polynomial of ``matrix``."""
    h = matrix.copy()
    for m in range(1, len(h) - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    return h


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, from the constant up, of det(t - matrix) modulo ``p``."""
    h, d = hessenberg(matrix, p), len(matrix)
    minors = np.zeros((d + 1, d + 1), dtype=np.int64)  # of the leading blocks
    minors[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, dtype=np.int64)
        row[1:] = minors[k - 1, :-1]
        row = (row - h[k - 1, k - 1] * minors[k - 1] % p) % p
        below = 1
        for i in range(k - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            row = (row - int(h[i - 1, k - 1]) * below % p * minors[i - 1] % p) % p
        minors[k] = row
    return minors[d]


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients, from the constant up, of det(t - matrix) of an integer matrix with no negative eigenvalue."""
    d, trace = len(matrix), int(np.trace(matrix))
    bound = max((Fraction(trace, d) ** k * math.comb(d, k)).__ceil__() for k in range(d + 1))  # means of the roots' products
    chosen = primes(bound.bit_length() + 1)
    rows = [[str(v) for v in r] for r in matrix]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = np.array([[int(v) for v in r] for r in rows], dtype=object)
        for frame in frames:
            found = [polynomial_modulo((numbers % p).astype(np.int64), p).tolist() for p in frame["p"].tolist()]
            yield pd.DataFrame({"p": frame["p"], "residues": found})

    table = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(min(len(chosen), 64))
    found = {r.p: r.residues for r in table.mapInPandas(run, "p long, residues array<long>").collect()}
    value, modulus = np.zeros(d + 1, dtype=object), 1
    for p in chosen:
        step = (np.array(found[p], dtype=object) - value) * pow(modulus, -1, p) % p
        value, modulus = value + modulus * step, modulus * p
    return [int(v) - modulus if 2 * int(v) > modulus else int(v) for v in value]


# -- its greatest roots ------------------------------------------------------------------------------------------------


def shifted(coefficients: list[int], a: int) -> list[int]:
    """Coefficients of p(t + a)."""
    out = list(coefficients)
    for i in range(len(out) - 1):
        for j in range(len(out) - 2, i - 1, -1):
            out[j] += a * out[j + 1]
    return out


def roots_above(coefficients: list[int], a: int) -> int:
    """Roots greater than ``a``, by their multiplicity: the sign changes of p(t + a), exact as all roots are real."""
    signs = [c > 0 for c in shifted(coefficients, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value_at(coefficients: list[int], a: int) -> int:
    out = 0
    for c in reversed(coefficients):
        out = out * a + c
    return out


def greatest_roots(coefficients: list[int], trace: int, most: int) -> tuple[list[int], int]:
    """(numerators, shift): the greatest roots are numerator / 2 ** shift, rounded up, by falling size and multiplicity.

    Roots lie in [0, trace]. An interval that holds one root only is halved by the sign of p at its middle.
    """
    d = len(coefficients) - 1
    shift = max(0, BITS - max(trace, 1).bit_length())
    scaled = [c << (shift * (d - i)) for i, c in enumerate(coefficients)]
    cache: dict[int, int] = {}

    def above(a: int) -> int:
        if a not in cache:
            cache[a] = roots_above(scaled, a)
        return cache[a]

    out: list[int] = []
    for r in range(1, min(most, d) + 1):
        low, high = -1, max(trace, 1) << shift  # above(low) >= r > above(high)
        for a, n in cache.items():
            low, high = (max(low, a), high) if n >= r else (low, min(high, a))
        while high - low > 1 and above(low) - above(high) > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if above(middle) >= r else (low, middle)
        if high - low > 1:
            last = value_at(scaled, high)
            while last and high - low > 1:  # the root is in (low, high]; p has one sign from beyond it to high
                middle = (low + high) // 2
                here = value_at(scaled, middle)
                if here and (here > 0) == (last > 0):
                    high = middle
                elif here:
                    low = middle
                else:
                    low, high = middle - 1, middle
        out.append(high)
    return out, shift


# -- components --------------------------------------------------------------------------------------------------------


def eigenvectors(matrix: np.ndarray, root: Fraction, count: int) -> np.ndarray:
    """``count`` orthogonal unit vectors (rows, doubles) of the null space of matrix - root, by inverse iteration."""
    d = len(matrix)
    digits = len(str(max(1, int(np.abs(matrix).max()))))
    with localcontext() as context:
        context.prec = 2 * digits + 2 * BITS // 3 + 20
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        a = np.array([[Decimal(int(v)) for v in r] for r in matrix], dtype=object)
        for i in range(d):
            a[i, i] -= shift
        tiny = Decimal(10) ** (digits - context.prec)
        order = list(range(d))
        for k in range(d):
            pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < d:
                a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - a[k + 1 :, k : k + 1] * a[k, k + 1 :]

        def solved(b: np.ndarray) -> np.ndarray:
            x = b[order].copy()
            for k in range(1, d):
                x[k] = x[k] - a[k, :k].dot(x[:k])
            for k in range(d - 1, -1, -1):
                x[k] = (x[k] - a[k, k + 1 :].dot(x[k + 1 :]) if k + 1 < d else x[k]) / a[k, k]
            return x

        def unit(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
            x = x / max(abs(v) for v in x)
            for _ in range(2):
                for o in others:
                    x = x - o * o.dot(x)
            return x / x.dot(x).sqrt()

        draw = np.random.Generator(np.random.PCG64(17))
        found: list[np.ndarray] = []
        for _ in range(count):
            x = np.array([Decimal(int(v)) for v in draw.integers(1, 1000, d)], dtype=object)
            for _ in range(3):
                x = unit(solved(unit(x, found)), found)
            found.append(x)
        return np.array([[float(v) for v in x] for x in found])


def components(spark: SparkSession, matrix: np.ndarray, most: int = MOST) -> tuple[list[Fraction], np.ndarray]:
    """(roots, unit vectors as rows) of the greatest eigenvalues of an integer matrix without negative ones."""
    divisor = math.gcd(*(int(v) for v in matrix.ravel())) or 1
    small = matrix // divisor
    numerators, shift = greatest_roots(characteristic(spark, small), int(np.trace(small)), most)
    groups: list[list[int]] = []  # (numerator, roots that are that near to each other)
    for r in numerators:
        if groups and groups[-1][0] - r <= 1:
            groups[-1][1] += 1
        else:
            groups.append([r, 1])
    rows = [[str(v) for v in r] for r in small]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = np.array([[int(v) for v in r] for r in rows], dtype=object)
        for frame in frames:
            found = [eigenvectors(numbers, Fraction(int(r), 1 << shift), n).tolist() for r, n in zip(frame["root"], frame["n"])]
            yield pd.DataFrame({"place": frame["place"], "vectors": found})

    table = spark.createDataFrame([(i, str(r), n) for i, (r, n) in enumerate(groups)], "place int, root string, n int").repartition(len(groups), "place")
    found = {r.place: r.vectors for r in table.mapInPandas(run, "place int, vectors array<array<double>>").collect()}
    return [Fraction(r * divisor, 1 << shift) for r in numerators], np.array([v for i in range(len(groups)) for v in found[i]])


# -- whitening ---------------------------------------------------------------------------------------------------------


def centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * y - sums: as 64-bit numbers where they are certain to fit, with their squares' sum; else as Python's."""
    bound = n * int(np.abs(y).max(initial=0)) + max(abs(s) for s in sums)
    if bound * bound * len(sums) < 1 << 63:
        return n * y - np.array(sums, dtype=np.int64)
    return n * y.astype(object) - np.array(sums, dtype=object)


def identity_error(fit: DataFrame, n: int, project) -> float:
    """Largest absolute entry of the covariance of the whitened ``fit``, less the identity."""

    def run_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = project(matrix_of(batch.column(0)))[1].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "value"])

    mean = {r.i: r.value / n for r in fit.select("x").mapInArrow(run_sums, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()}
    means = np.array([mean[i] for i in range(len(mean))])

    def run_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = project(matrix_of(batch.column(0)))[1] - means
            cells = pa.array(range(w.shape[1] ** 2), pa.int32())
            yield pa.RecordBatch.from_arrays([cells, pa.array((w.T @ w).ravel())], names=["i", "value"])

    found = fit.select("x").mapInArrow(run_products, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()
    size = len(means)
    return max(abs(r.value / n - (r.i // size == r.i % size)) for r in found)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """Rows (vec_id, component int, n long, deviation long, whitened double, explained double, identity_error double).

    One row for each usable vector and each of the first ``most`` components of the covariance of the distinct vectors x;
    ``deviation`` is the sum of (n * x - sums) ** 2 over the dimensions, null where no long holds it.

    Vectors that are null or empty, or hold a null, a non-finite entry or one of ``LARGEST`` / ``SCALE`` or more, are left
    out; so are those of another length than most vectors have (of two such lengths, the greater). Repeated rows stay rows,
    and count once in the fit. A component without variance has a null ``whitened`` and does not count in
    ``identity_error``; without any variance ``explained`` and ``identity_error`` are null. Equal eigenvalues get
    orthogonal components of their space. Further columns are not looked at. No usable vector: no rows.
    """
    spark = vectors.sparkSession
    rows = stored(whole(vectors, key, vector), "vectors")
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == length.d)
    fit = stored(rows.select("x").distinct(), "fit")
    n, sums, products = totals(fit)
    scatter = n * products - np.outer(sums, sums)  # n ** 2 times the covariance
    trace = int(np.trace(scatter))
    roots, axes = components(spark, scatter, most)
    zero = [r * (1 << BITS) < trace or not trace for r in roots]  # what is left of a root 0 by its rounding
    deviations = np.array([math.sqrt(r / n**2) if not z else math.nan for r, z in zip(roots, zero)])
    explained = [None if not trace else 0.0 if z else float(r / trace) for r, z in zip(roots, zero)]
    plain_sums = [int(s) for s in sums]

    def project(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * y - sums, whitened), without the components of no variance."""
        moved = centred(y, n, plain_sums)
        kept = ~np.isnan(deviations)
        return moved, (moved.astype(np.float64) / n) @ axes[kept].T / deviations[kept]

    error = identity_error(fit, n, project) if not all(zero) else None
    count, used = len(roots), [i for i, z in enumerate(zero) if not z]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                moved, values = project(matrix_of(batch.column(1)))
                squares = (moved * moved).sum(axis=1)
                squares = pa.array([int(v) if v < 1 << 63 else None for v in squares.tolist()], pa.int64())
                white = np.full((batch.num_rows, count), np.nan)
                white[:, used] = values
                again = pa.array(np.repeat(np.arange(batch.num_rows), count))
                total = batch.num_rows * count
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(again),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), batch.num_rows)),
                        pa.array(np.full(total, n)),
                        squares.take(again),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(explained * batch.num_rows, pa.float64()),
                        pa.array([error] * total, pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
