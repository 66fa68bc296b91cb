"""Whitening of vectors with exact second moments.

Components become whole numbers, so the scatter matrix is a matrix of integers.  Its
characteristic polynomial is found modulo many primes, one reduction to Hessenberg form a task,
and put together by the Chinese remainder theorem.  All its roots are real, so the number of
roots above a point is the number of sign changes of the polynomial shifted there; bisection
with whole numbers isolates each root as finely as wanted.  Components are null vectors of the
matrix less a root, by inverse iteration in fixed point.

The driver holds what grows with the dimensions alone: the matrix and its polynomial.  Rows and
distinct vectors stay in tasks.

Edge cases: rows whose vector is null or holds null or non-finite entries are dropped; shorter
vectors end in zeros; null ids and repeated rows are rows of their own, and repeated vectors count
once in the fit; entries beyond 2^45 count as that; an empty table, or one of empty vectors, gives
an empty result.  A component of variance zero can't be whitened: only the components with a
positive eigenvalue are returned.  A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import materialize

SCALE, SHIFT = 64, 1_000_000
#: Bits to which roots and null vectors are found.
ROOT_BITS, VECTOR_BITS = 96, 320
LARGEST = 2.0**51


def whole_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, x): floor(64 c) + 1000000 of each entry as whole numbers, ``dims`` of them."""
    entry = lambda c: (F.greatest(F.least(F.floor(c * SCALE), F.lit(LARGEST).cast("long")), F.lit(-LARGEST).cast("long")) + SHIFT).cast("long")
    most, least = F.lit(LARGEST / SCALE), F.lit(-LARGEST / SCALE)
    clipped = F.transform(F.col("embedding").cast("array<double>"), lambda c: entry(F.greatest(F.least(c, most), least)))
    full = F.concat(clipped, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dims) - F.size("embedding")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), full.alias("x"))


def eligible(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where("embedding is not null").where(finite).select("vec_id", "embedding")


def _table(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def _exact(table: np.ndarray) -> np.ndarray:
    """64-bit numbers if products summed over the rows fit, else Python's."""
    most = max(abs(int(table.min(initial=0))), abs(int(table.max(initial=0))))
    return table if most * most * max(1, len(table)) < 1 << 62 else table.astype(object)


def _sums(dims: int, centre: list[int]):
    """Partial sums of each partition: y and the upper half of y y', y being x less a centre."""
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, linear, square = 0, np.zeros(dims, object), np.zeros(len(upper[0]), object)
        for batch in batches:
            y = _exact(_table(batch, dims) - np.array(centre, np.int64))
            n += len(y)
            linear += y.sum(axis=0).astype(object)
            square += (y.T @ y)[upper].astype(object)
        values = [Decimal(int(v)) for v in (n, *linear, *square)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["place", "value"])

    return run


def moments(distinct: DataFrame, dims: int, centre: list[int]) -> tuple[int, list[int], np.ndarray]:
    """(n, sums of y, integer scatter n * sum(y y') - sums sums', which is n^2 times the covariance)."""
    parts = distinct.select("x").mapInArrow(_sums(dims, centre), "place int, value decimal(38,0)")
    # a number for each pair of dimensions
    found = {r["place"]: int(r["value"]) for r in parts.groupBy("place").agg(F.sum("value").cast("decimal(38,0)").alias("value")).collect()}
    n, linear = found.get(0, 0), [found.get(1 + k, 0) for k in range(dims)]
    scatter = np.zeros((dims, dims), object)
    for place, (i, j) in enumerate(zip(*np.triu_indices(dims))):
        scatter[i, j] = scatter[j, i] = n * found.get(1 + dims + place, 0) - linear[i] * linear[j]
    return n, linear, scatter


def primes(count: int) -> list[int]:
    """The largest ``count`` primes below 2^31."""
    found, n, small = [], (1 << 31) - 1, [p for p in range(3, isqrt(1 << 31) + 1, 2) if all(p % q for q in range(3, isqrt(p) + 1, 2))]
    small = np.array(small)
    while len(found) < count:
        if (n % small).all():
            found.append(n)
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo a prime, the constant first, by a Hessenberg form."""
    h = np.array([[int(v) % p for v in row] for row in matrix], np.int64)
    n = len(h)
    for m in range(1, n - 1):
        pivot = np.flatnonzero(h[m:, m - 1])
        if not len(pivot):
            continue
        k = m + int(pivot[0])
        if k != m:
            h[[m, k]] = h[[k, m]]
            h[:, [m, k]] = h[:, [k, m]]
        factor = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        # rows lose a multiple of row m; columns are changed the other way, so roots stay
        h[m + 1 :] = (h[m + 1 :] - factor[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factor % p).sum(axis=1)) % p
    rows = [np.zeros(n + 1, np.int64) for _ in range(n + 1)]
    rows[0][0] = 1
    for m in range(1, n + 1):
        new = np.roll(rows[m - 1], 1)
        new = (new - int(h[m - 1, m - 1]) * rows[m - 1] % p) % p
        below = 1
        for i in range(1, m):
            below = below * int(h[m - i, m - i - 1]) % p
            if below == 0:
                break
            new = (new - below * int(h[m - 1 - i, m - 1]) % p * rows[m - 1 - i] % p) % p
        rows[m] = new
    return rows[n].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients for a positive semidefinite integer matrix, the constant first."""
    n = len(matrix)
    trace = sum(int(matrix[k, k]) for k in range(n))
    # symmetric functions of roots that are not negative are largest where all are equal
    bound = max(comb(n, k) * (trace // n + 1) ** k for k in range(n + 1))
    chosen = primes(2 + (2 * bound).bit_length() // 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch["id"].to_pylist():
                yield pa.RecordBatch.from_pylist([{"p": p, "residues": polynomial_modulo(matrix, p)}])

    table = spark.createDataFrame([(p,) for p in chosen], "id long").repartition(min(len(chosen), 64))
    residues = {r["p"]: r["residues"] for r in table.mapInArrow(run, "p long, residues array<long>").collect()}
    out, modulus = [0] * (n + 1), 1
    for p in chosen:
        inverse = pow(modulus, -1, p)
        out = [c + (r - c) * inverse % p * modulus for c, r in zip(out, residues[p])]
        modulus *= p
    return [c - modulus if 2 * c > modulus else c for c in out]


def roots_above(polynomial: list[int], point: int, bits: int) -> int:
    """How many of its roots, all real, lie above point / 2^bits: sign changes after a shift there."""
    n = len(polynomial) - 1
    # roots times 2^bits are those of this one
    c = [a << bits * (n - k) for k, a in enumerate(polynomial)]
    for i in range(n):
        for k in range(n - 1, i - 1, -1):
            c[k] += point * c[k + 1]
    signs = [a > 0 for a in c if a]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], count: int, trace: int) -> list[Fraction]:
    """The largest ``count`` roots that are positive, falling, each as often as it occurs."""
    positive = roots_above(polynomial, 0, 0)
    count = min(count, positive)
    out: list[Fraction] = []
    # (first root's number, number of roots, interval) of each part that is still too wide
    waiting = [(0, positive, 0, trace.bit_length() and 1 << trace.bit_length(), 0)]
    while waiting:
        first, n, low, high, bits = waiting.pop()
        if first >= count:
            continue
        if low > 0 and (high - low) << ROOT_BITS <= low or bits > 4096:
            out += [(first + k, Fraction(low + high, 2 << bits)) for k in range(min(n, count - first))]
            continue
        if high - low == 1:
            low, high, bits = low << 8, high << 8, bits + 8
        middle = (low + high) // 2
        above = roots_above(polynomial, middle, bits)
        whole = n + first
        # roots above the interval are numbered before ``first``
        inside = above - first
        if whole - above > 0:
            waiting.append((above, whole - above, low, middle, bits))
        if inside > 0:
            waiting.append((first, inside, middle, high, bits))
    return [r for _, r in sorted(out)]


def _solver(matrix: np.ndarray, root: Fraction):
    """Solves (matrix - root) v = b in fixed point of VECTOR_BITS bits, by elimination with pivots."""
    n, one = len(matrix), 1 << VECTOR_BITS
    at = int(root * one)
    size = max(int(root), 1).bit_length()
    # scaled by the root, so that entries are about one
    a = [[(((int(v) << VECTOR_BITS) - (at if i == j else 0)) >> size) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
    steps = []
    for k in range(n):
        pivot = max(range(k, n), key=lambda i: abs(a[i][k]))
        a[k], a[pivot] = a[pivot], a[k]
        if a[k][k] == 0:
            a[k][k] = 1
        top, factors = a[k], []
        for i in range(k + 1, n):
            f = (a[i][k] << VECTOR_BITS) // top[k]
            factors.append(f)
            if f:
                row = a[i]
                for j in range(k + 1, n):
                    row[j] -= f * top[j] >> VECTOR_BITS
        steps.append((pivot, factors))

    def solve(b: list[int]) -> list[int]:
        b = list(b)
        for k, (pivot, factors) in enumerate(steps):
            b[k], b[pivot] = b[pivot], b[k]
            for i, f in enumerate(factors, k + 1):
                b[i] -= f * b[k] >> VECTOR_BITS
        for k in reversed(range(n)):
            b[k] = ((b[k] - (sum(a[k][j] * b[j] for j in range(k + 1, n)) >> VECTOR_BITS)) << VECTOR_BITS) // a[k][k]
        return b

    return solve


def _unit(v: list[int]) -> list[int]:
    norm = isqrt(sum(x * x for x in v))
    return [(x << VECTOR_BITS) // norm for x in v]


def null_vectors(matrix: np.ndarray, roots: list[Fraction]) -> np.ndarray:
    """Unit vectors, a row for each root; those of close roots are made orthogonal."""
    n, done, last = len(matrix), [], None
    for k, root in enumerate(roots):
        if root != last:
            solve, last = _solver(matrix, root), root
        close = [v for r, v in done if abs(r - root) * (1 << ROOT_BITS // 2) <= root]
        # any start that isn't orthogonal to what is looked for; three rounds square away the rest
        v = _unit([((2 * i + 3) * (k + 7) * 2654435761 % 1009) + 1 << 64 for i in range(n)])
        for _ in range(3):
            v = _unit(solve(v))
            for other in close:
                along = sum(x * y for x, y in zip(v, other)) >> VECTOR_BITS
                v = [x - (along * y >> VECTOR_BITS) for x, y in zip(v, other)]
            v = _unit(v)
        done.append((root, v))
    return np.array([[x / (1 << VECTOR_BITS) for x in v] for _, v in done]).reshape(len(done), n)


def _projected(dims: int, n: int, sums: list[int], centre: list[int], axes: np.ndarray, size: np.ndarray):
    """Each row's deviation and whitened components."""
    middle = np.array([float(Fraction(s, n) - c) for s, c in zip(sums, centre)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, c = np.array(sums, object), np.array(centre, np.int64)
        for batch in batches:
            x = _table(batch, dims)
            y = x - c
            whitened = (y - middle) @ axes.T / size
            rest = np.array([n * m - s for m, s in zip(c.tolist(), sums)], object)
            most = n * max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0)))) + max(map(abs, rest.tolist()), default=0)
            off = y * n + rest.astype(np.int64) if most * most * dims < 1 << 62 else y.astype(object) * n + rest
            deviation = (off * off).sum(axis=1).tolist()
            deviation = pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64())
            offsets = pa.array(np.arange(len(x) + 1) * len(axes), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], deviation, pa.ListArray.from_arrays(offsets, pa.array(whitened.ravel()))], names=["vec_id", "deviation", "parts"])

    return run


def _products(k: int, dims: int, middle: np.ndarray, centre: list[int], axes: np.ndarray, size: np.ndarray):
    """Sums of whitened components and of their products over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linear, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = (_table(batch, dims) - np.array(centre, np.int64) - middle) @ axes.T / size
            linear += w.sum(axis=0)
            square += w.T @ w
        values = np.append(linear, square.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["place", "value"])

    return run


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component.

    Exact for any number of rows; the polynomial's cost grows with the fourth power of the
    dimensions, so it is meant for hundreds of them.
    """
    spark = vectors.sparkSession
    kept = eligible(vectors)
    dims = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if dims == 0:
        return spark.createDataFrame([], result)
    rows = whole_vectors(kept, dims)
    distinct = materialize(rows.select("x").distinct(), "distinct-vectors")
    # a centre near the mean keeps the numbers small; sums of whole numbers are exact with any
    means = distinct.agg(F.count(F.lit(1)), *[F.sum(F.col("x")[k].cast("decimal(38,0)")) for k in range(dims)]).first()
    n, sums = int(means[0]), [int(v) for v in means[1:]]
    centre = [s // n for s in sums]
    _, _, scatter = moments(distinct, dims, centre)
    trace = sum(int(scatter[k, k]) for k in range(dims))
    roots = largest_roots(characteristic_polynomial(spark, scatter), components, trace)
    if not roots:
        return spark.createDataFrame([], result)
    axes = null_vectors(scatter, roots)
    size = np.array([float(r / n**2) ** 0.5 for r in roots])
    explained = [float(r / trace) for r in roots]
    middle = np.array([float(Fraction(s, n) - c) for s, c in zip(sums, centre)])
    k = len(roots)
    parts = distinct.mapInArrow(_products(k, dims, middle, centre, axes, size), "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    found = dict(sorted((r["place"], r["value"]) for r in parts.collect()))
    linear = np.array([found[i] for i in range(k)]) / n
    covariance = np.array([found[k + i] for i in range(k * k)]).reshape(k, k) / n - np.outer(linear, linear)
    error = float(np.abs(covariance - np.eye(k)).max())
    told = F.array(*[F.lit(e) for e in explained])
    out = rows.mapInArrow(_projected(dims, n, sums, centre, axes, size), "vec_id long, deviation long, parts array<double>")
    return out.select("vec_id", "deviation", F.posexplode("parts").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        told[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"))
