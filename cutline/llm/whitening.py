"""Embedding whitening along principal components found from an exact characteristic polynomial.

Entries become whole numbers, so counts, sums and products of the fit list (each distinct vector once)
are exact at any size. From them comes the integer scatter ``A = n * sum(x x') - S S'``, which is n*n
times the covariance. Its characteristic polynomial is computed modulo as many primes as its
coefficients need, each by Hessenberg reduction in its own row of a Spark job, and put together by
Chinese remainders. All its roots are real, so the sign changes of its coefficients after a shift count
the roots beyond a point exactly; halving isolates the largest roots, and signs then narrow them to
``BITS`` relative bits. Inverse iteration on the near-singular ``A - root`` with ``DIGITS`` decimal
digits beyond those of A gives the vectors of its null space.

What reaches the driver depends on the number of dimensions only: sums of products, polynomial
coefficients and sixteen vectors.

Defined results: a row whose vector is null or has null or non-finite entries is dropped; a repeated or
null vec_id stays, one set of results per row. Vectors of each length are a fit of their own. Roots of
zero have no component, so a fit list with one vector, and empty vectors, give no rows; equal roots get
any orthonormal vectors of their space. Entries beyond 2**62 after scaling count as 2**62. An empty
table gives no rows. Columns besides vec_id and embedding are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.store import stored

COMPONENTS = 16
#: Relative width of a root's last interval, and digits of the inverse iteration beyond those of the scatter.
BITS = 120
DIGITS = 60
LARGEST = 1 << 62
SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
    "identity_error double, deviation_digits string"
)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, y, dim): ``y`` is floor(64 * entry); the contract's x is a million more, which cancels everywhere."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & ~bad)
    y = F.transform("v", lambda c: F.greatest(F.least(F.floor(c * 64), F.lit(LARGEST)), F.lit(-LARGEST)))
    return rows.select("vec_id", y.alias("y"), F.size("v").alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def products(y: np.ndarray) -> np.ndarray:
    """Exact ``y' y`` of whole numbers, as Python numbers: sums of 16-bit limbs stay below 2**53."""
    sign, size = np.sign(y), np.abs(y)
    limbs = []
    while not limbs or size.any():
        limbs.append((sign * (size & 0xFFFF)).astype(float))
        size = size >> 16
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for a, left in enumerate(limbs):
        for b, right in enumerate(limbs):
            part = sum((left[k : k + (1 << 20)].T @ right[k : k + (1 << 20)]).astype(np.int64).astype(object) for k in range(0, len(y), 1 << 20))
            total = total + part * (1 << (16 * (a + b)))
    return total


def _summing(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1), object)
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column(0), dim)
                total = total + products(np.column_stack([y, np.ones(len(y), np.int64)]))
        i, j = np.triu_indices(dim + 1)
        cells = total[i, j]
        whole = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                pa.array([Decimal(c >> 60) for c in cells], whole), pa.array([Decimal(c & ((1 << 60) - 1)) for c in cells], whole),
            ],
            ["i", "j", "high", "low"],
        )

    return run


def scatter(fit: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums, and the integer scatter of the vectors ``y`` of ``fit``."""
    cells = fit.mapInArrow(_summing(dim), "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low")
    )
    total = [[0] * (dim + 1) for _ in range(dim + 1)]
    for r in cells.collect():
        total[r["i"]][r["j"]] = total[r["j"]][r["i"]] = (int(r["high"]) << 60) + int(r["low"])
    n, sums = total[dim][dim], total[dim][:dim]
    return n, sums, [[n * total[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]


def characteristic(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, lowest first, of det(x - matrix) modulo a prime below 2**31, by Hessenberg reduction."""
    h = matrix.copy()
    d = len(h)
    for k in range(1, d - 1):
        at = k + int(np.argmax(h[k:, k - 1] != 0))
        if h[at, k - 1] == 0:
            continue
        if at != k:
            h[[at, k]] = h[[k, at]]
            h[:, [at, k]] = h[:, [k, at]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * u % p).sum(axis=1)) % p
    # Leading blocks: each polynomial from those before it and the products below the diagonal.
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        row = -h[k - 1, k - 1] * polys[k - 1] % p
        row[1:] = (row[1:] + polys[k - 1, :-1]) % p
        if k > 1:
            below = np.empty(k - 1, np.int64)
            product = 1
            for i in range(1, k):
                product = product * int(h[k - i, k - i - 1]) % p
                below[i - 1] = product * int(h[k - 1 - i, k - 1]) % p
            row = (row - (below[:, None] * polys[k - 2 :: -1][: k - 1] % p).sum(axis=0)) % p
        polys[k] = row
    return polys[d]


def primes(bits: float) -> list[int]:
    """Primes downwards from 2**31 whose product has more than ``bits`` bits."""
    small = np.ones(46342, bool)
    small[:2] = False
    for k in range(2, 216):
        if small[k]:
            small[k * k :: k] = False
    small = np.flatnonzero(small)
    found, product, top = [], 0.0, 1 << 31
    while product <= bits:
        block = np.ones(1 << 16, bool)  # top - 1 - i
        for s in small:
            block[(top - 1) % s :: s] = False
        for i in np.flatnonzero(block):
            found.append(top - 1 - int(i))
            product += math.log2(found[-1])
            if product > bits:
                break
        top -= 1 << 16
    return found


def polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Exact coefficients, lowest first, of the characteristic polynomial of a positive semidefinite matrix."""
    d = len(a)
    trace = sum(a[i][i] for i in range(d))
    # The k-th coefficient is the k-th symmetric function of the roots: at most C(d, k) * (trace / d)**k.
    bits = 3 + max(
        math.log2(math.comb(d, k)) + k * (math.log2(trace) - math.log2(d) if trace else 0) for k in range(d + 1)
    )
    found = primes(bits)
    sent = spark.sparkContext.broadcast(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for p in batch.column(0).to_pylist():
                reduced = np.array([[v % p for v in row] for row in own], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int64()), pa.array([characteristic(reduced, p).tolist()], pa.list_(pa.int64()))], ["p", "c"]
                )

    asked = spark.createDataFrame([(p,) for p in found], "p bigint").repartition(min(len(found), spark.sparkContext.defaultParallelism * 2))
    parts = sorted((r["p"], r["c"]) for r in asked.mapInArrow(run, "p bigint, c array<bigint>").collect())
    product = math.prod(p for p, _ in parts)
    weights = [(product // p) * pow(product // p, -1, p) for p, _ in parts]
    out = []
    for k in range(d + 1):
        c = sum(w * part[k] for w, (_, part) in zip(weights, parts)) % product
        out.append(c - product if 2 * c > product else c)
    return out


class RealRooted:
    """A polynomial with real roots only, none below zero: counts its roots beyond points m / 2**s."""

    def __init__(self, coefficients: list[int]):
        self.c = coefficients
        self.known: dict[Fraction, int] = {}

    def beyond(self, at: Fraction) -> int:
        """Roots greater than a point, by the sign changes of the shifted coefficients."""
        if at not in self.known:
            s = at.denominator.bit_length() - 1
            d = len(self.c) - 1
            c = [v << (s * (d - i)) for i, v in enumerate(self.c)]
            m = at.numerator
            if m:
                for i in range(d):
                    for j in range(d - 1, i - 1, -1):
                        c[j] += m * c[j + 1]
            signs = [v > 0 for v in c if v]
            self.known[at] = sum(x != y for x, y in zip(signs, signs[1:]))
        return self.known[at]

    def sign(self, at: Fraction) -> int:
        s = at.denominator.bit_length() - 1
        value, power = 0, 0
        for v in reversed(self.c):
            value = value * at.numerator + (v << power)
            power += s
        return (value > 0) - (value < 0)

    def largest(self, count: int, bits: int = BITS) -> list[tuple[Fraction, int]]:
        """The largest positive roots with their multiplicities, ``count`` of them or all, falling."""
        count = min(count, self.beyond(Fraction(0)))
        top = Fraction(1 << max(1, abs(self.c[-2]).bit_length()))
        out, met = [], 0
        while met < count:
            # Each search halves the same first interval, so its points stay short and counts are shared.
            low, high = Fraction(0), top
            while True:
                inside = self.beyond(low) - met
                if (inside == 1 and self.beyond(high) == met) or (low and (high - low) * (1 << bits) <= low):
                    break
                middle = (low + high) / 2
                if self.beyond(middle) > met:
                    low = middle
                else:
                    high = middle
            if inside == 1:
                while not low or (high - low) * (1 << bits) > low:
                    middle = (low + high) / 2
                    sign = self.sign(middle)
                    if sign == 0:
                        low = high = middle
                    elif (sign < 0) == (met % 2 == 0):
                        low = middle
                    else:
                        high = middle
            out.append((high, inside))
            met += inside
        return out


def null_space(a: list[list[int]], root: Fraction, multiplicity: int) -> np.ndarray:
    """Orthonormal vectors (multiplicity x d) of the space of one root, by inverse iteration."""
    d = len(a)
    with localcontext() as context:
        context.prec = DIGITS + len(str(max(1, max(abs(v) for row in a for v in row)))) + len(str(d))
        m = np.array([[Decimal(v) for v in row] for row in a], object)
        shift = Decimal(root.numerator) / Decimal(root.denominator)
        m[np.diag_indices(d)] = m[np.diag_indices(d)] - shift
        tiny = shift.scaleb(-(context.prec - 5))
        order = np.arange(d)
        for k in range(d):
            at = k + int(np.argmax(np.abs(m[k:, k])))
            if at != k:
                m[[at, k]] = m[[k, at]]
                order[[at, k]] = order[[k, at]]
            if abs(m[k, k]) < tiny:
                m[k, k] = tiny
            if k + 1 < d:
                m[k + 1 :, k] = m[k + 1 :, k] / m[k, k]
                m[k + 1 :, k + 1 :] = m[k + 1 :, k + 1 :] - np.outer(m[k + 1 :, k], m[k, k + 1 :])
        start = np.random.default_rng(5).integers(-1000, 1000, (multiplicity, d))
        vectors = [np.array([Decimal(int(x)) for x in row], object) for row in start]
        for _ in range(4):
            solved = []
            for v in vectors:
                x = v[order].copy()
                for k in range(1, d):
                    x[k] = x[k] - (m[k, :k] * x[:k]).sum()
                for k in range(d - 1, -1, -1):
                    if k + 1 < d:
                        x[k] = x[k] - (m[k, k + 1 :] * x[k + 1 :]).sum()
                    x[k] = x[k] / m[k, k]
                for _ in range(2):
                    for other in solved:
                        x = x - other * (other * x).sum()
                    x = x / (x * x).sum().sqrt()
                solved.append(x)
            vectors = solved
        out = np.array([[float(c) for c in v] for v in vectors])
    return out * np.sign(out[np.arange(len(out)), np.abs(out).argmax(axis=1)])[:, None]


def components(spark: SparkSession, a: list[list[int]], count: int = COMPONENTS) -> tuple[np.ndarray, list[Fraction]]:
    """Unit vectors (rows) and roots of the scatter by falling root; each root's vectors in its own task."""
    roots = RealRooted(polynomial(spark, a)).largest(count)
    if not roots:
        return np.zeros((0, len(a))), []
    sent = spark.sparkContext.broadcast(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for k, up, down, many in zip(*[c.to_pylist() for c in batch.columns]):
                vectors = null_space(own, Fraction(int(up), int(down)), many)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * many, pa.int32()), pa.array(range(many), pa.int32()), pa.array(vectors.tolist(), pa.list_(pa.float64()))],
                    ["k", "i", "v"],
                )

    asked = spark.createDataFrame([(k, str(r.numerator), str(r.denominator), m) for k, (r, m) in enumerate(roots)], "k int, up string, down string, many int")
    found = asked.repartition(len(roots)).mapInArrow(run, "k int, i int, v array<double>").collect()
    vectors = np.array([r["v"] for r in sorted(found, key=lambda r: (r["k"], r["i"]))])
    return vectors[:count], [r for r, m in roots for _ in range(m)][:count]


def centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact ``n * y - sums``: longs where they fit, else Python numbers."""
    if n * int(np.abs(y).max(initial=0)) + max((abs(s) for s in sums), default=0) < 1 << 62:
        return y * np.int64(n) - np.array(sums, np.int64)
    return y.astype(object) * n - np.array(sums, object)


def _projected(c: np.ndarray, axes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return c.astype(float) @ axes.T / scale


def identity_error(fit: DataFrame, dim: int, n: int, sums: list[int], axes: np.ndarray, scale: np.ndarray) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity), centred within each task."""
    k = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            w = _projected(centred(_matrix(batch.column(0), dim), n, sums), axes, scale)
            own = w.mean(axis=0)
            away, more = own - mean, len(w)
            spread += (w - own).T @ (w - own) + np.outer(away, away) * (count * more / (count + more))
            mean += away * (more / (count + more))
            count += more
        i, j = (x.ravel() for x in np.indices((k, k)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(spread.ravel()), pa.array(count * mean[i]), pa.array(count * mean[j]), pa.array(count * mean[i] * mean[j])],
            ["i", "j", "within", "a", "b", "ab"],
        )

    parts = fit.mapInArrow(run, "i int, j int, within double, a double, b double, ab double")
    cell = F.sum("within") / n + F.sum("ab") / n - (F.sum("a") / n) * (F.sum("b") / n)
    error = F.abs(F.col("cell") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return parts.groupBy("i", "j").agg(cell.alias("cell")).agg(F.max(error)).first()[0]


def _whitening(dim: int, n: int, sums: list[int], axes: np.ndarray, scale: np.ndarray, shares: list[float], error: float):
    k = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            c = centred(_matrix(batch.column(1), dim), n, sums)
            w = _projected(c, axes, scale)
            if c.dtype != object and int(np.abs(c).max()) ** 2 * dim < 1 << 63:
                exact = (c * c).sum(axis=1).tolist()
            else:
                exact = [sum(v * v for v in row) for row in c.tolist()]
            fits = [v if v < 1 << 63 else None for v in exact]
            digits = [None if v < 1 << 63 else str(v) for v in exact]
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(fits, pa.int64()).take(each),
                    pa.array(w.ravel()),
                    pa.array(np.tile(np.array(shares, float), rows)),
                    pa.array(np.full(rows * k, error)),
                    pa.array(digits, pa.string()).take(each),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
            )

    return run


def whiten(vectors: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of ``vectors`` (vec_id, embedding) and component; see ``SCHEMA``.

    ``deviation_digits`` holds the exact deviation where a long cannot, and ``deviation`` is null there.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors).where("dim > 0")
    fit = stored(rows.select("y", "dim").distinct(), "whitening-fit")
    out = None
    for r in fit.groupBy("dim").count().orderBy("dim").collect():
        dim = r["dim"]
        own = fit.where(F.col("dim") == dim).select("y")
        n, sums, a = scatter(own, dim)
        axes, roots = components(spark, a, count)
        if not roots:
            continue
        scale = np.array([_root(r) for r in roots])
        trace = sum(a[i][i] for i in range(dim))
        shares = [float(r / trace) for r in roots]
        error = identity_error(own, dim, n, sums, axes, scale)
        part = rows.where(F.col("dim") == dim).select("vec_id", "y").mapInArrow(_whitening(dim, n, sums, axes, scale, shares, error), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _root(x: Fraction) -> float:
    """Square root of a rational, to double precision."""
    with localcontext() as context:
        context.prec = 50
        return float((Decimal(x.numerator) / Decimal(x.denominator)).sqrt())
