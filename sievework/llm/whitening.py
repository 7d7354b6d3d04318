"""Whitening of embeddings by principal components found in exact arithmetic.

Vectors become integers, so that their scatter n * sum(x x') - S S' is an
integer matrix: tasks add it up without rounding, and it does not depend on how
rows were dealt. Its characteristic polynomial is found modulo many primes, a
task each (Hessenberg form, then the recurrence of its leading minors), and put
together by Chinese remainders. All its roots are real, so that the changes of
sign of its coefficients, shifted to t, are exactly the roots above t:
bisection isolates the largest ones with their multiplicity to 120 bits. Each
root's eigenvectors are the null space of scatter - root, found by inverse
iteration in 80-digit decimals.

What reaches the driver is of the size of the scatter (dimensions squared), in
at most MERGED pieces, and one residue a prime and coefficient.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Pieces of the scatter that the driver adds up.
MERGED = 16
#: Bits of a limb and rows that a product of limbs adds up, so that a double holds the sum.
LIMB, ROWS = 20, 4096
#: Values outside +-2^62 are taken as that.
MOST = 1 << 62
#: Bits of the trace to which roots are isolated, and digits of the decimals.
BITS, DIGITS = 120, 80


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, v): vectors of numbers all finite, as doubles."""
    v = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """floor(1024 c), one row a vector. The contract's x is this plus 100000;
    covariances and distances from the mean do not change with that."""
    with np.errstate(over="ignore"):
        y = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * SCALE)
    return np.clip(y, -float(MOST), float(MOST)).astype(np.int64)


def products(y: np.ndarray) -> np.ndarray:
    """y'y without rounding, as Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for k in range(0, len(y), ROWS):
        part, limbs = y[k : k + ROWS], []
        while len(part) and np.abs(part).max() >= 1 << LIMB:
            limbs.append((part & ((1 << LIMB) - 1)).astype(np.float64))
            part = part >> LIMB
        limbs.append(part.astype(np.float64))
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def _coded(total: np.ndarray) -> pa.RecordBatch:
    upper = total[np.triu_indices(len(total))]
    return pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, upper))])], ["part"])


def _decoded(part: str, size: int) -> np.ndarray:
    total = np.zeros((size, size), object)
    total[np.triu_indices(size)] = [int(x) for x in part.split(" ")]
    return total


def _partial(dims: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = integers(batch.column("v"), dims)
                found = products(np.hstack([y, np.ones((len(y), 1), np.int64)]))  # the last column holds sums and the count
                total = found if total is None else total + found
        if total is not None:
            yield _coded(total)

    return add


def _merged(dims: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column("part").to_pylist():
                total = _decoded(part, dims + 1) if total is None else total + _decoded(part, dims + 1)
        if total is not None:
            yield _coded(total)

    return add


def scatter(good: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums and n * sum(y y') - S S' of all rows of `good`, exactly."""
    parts = good.select("v").mapInArrow(_partial(dims), "part string").repartition(MERGED).mapInArrow(_merged(dims), "part string")
    total = np.zeros((dims + 1, dims + 1), object)
    for row in parts.collect():  # at most MERGED rows
        total = total + _decoded(row.part, dims + 1)
    n, sums = int(total[dims, dims]), [int(s) for s in total[:dims, dims]]
    full = total[:dims, :dims] + np.triu(total[:dims, :dims], 1).T
    return n, sums, [[n * int(full[i, j]) - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]


def primes_below(limit: int, how_many: int) -> list[int]:
    """The largest primes below a limit of at most 2^31, largest first."""
    def prime(p: int) -> bool:  # these bases decide below 3.2 * 10^9
        d, r = p - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for base in (2, 3, 5, 7):
            x = pow(base, d, p)
            if x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(r - 1)):
                return False
        return True

    out, p = [], limit - 1 - limit % 2
    while len(out) < how_many:
        if prime(p):
            out.append(p)
        p -= 2
    return out


def charpoly_mod(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo a prime below 2^31, lowest first."""
    n = len(matrix)
    h = np.array([[x % p for x in row] for row in matrix], np.int64).reshape(n, n)
    for m in range(1, n - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        if below[0]:
            i = m + int(below[0])
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(1)) % p
    minors = np.zeros((n + 1, n + 1), np.int64)
    minors[0, 0] = 1
    for k in range(n):
        minors[k + 1, 1:] = minors[k, :-1]
        weights, run = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * run % p
            run = run * int(h[i, i - 1]) % p if i else run
        minors[k + 1] = (minors[k + 1] - (weights[:, None] * minors[: k + 1] % p).sum(0)) % p
    return minors[n]


def _residues(matrix: list[list[int]]):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([charpoly_mod(matrix, p).tolist()])], ["p", "c"])

    return reduce


def charpoly(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), lowest first, of an integer matrix without negative eigenvalues.

    The product of 1 + root bounds each coefficient, and is itself at most
    (1 + trace / n)^n; the primes' product is above twice that.
    """
    n = len(matrix)
    mean = sum(matrix[i][i] for i in range(n)) // n + 2
    primes = primes_below(1 << 31, n * mean.bit_length() // 30 + 2)
    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(len(primes))
    rows = dealt.mapInArrow(_residues(matrix), "p long, c array<long>").collect()
    whole = math.prod(primes)
    parts = [(whole // r.p * pow(whole // r.p, -1, r.p), r.c) for r in rows]
    found = [sum(f * c[k] for f, c in parts) % whole for k in range(n + 1)]
    return [c - whole if c > whole // 2 else c for c in found]


def roots_above(poly: list[int], t: int) -> int:
    """How many roots of a polynomial with real roots only lie above t, each as often as it occurs."""
    c = list(poly)
    for i in range(len(c) - 1):  # c becomes the polynomial in x + t
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += t * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], trace: int, most: int) -> tuple[list[tuple[int, int]], int]:
    """[(m, times)], falling, and b: root in (m - 1, m] / 2^b, `times` roots there; positive roots only, `most` or a few more."""
    bits = max(0, BITS - trace.bit_length())
    n = len(poly) - 1
    fine = [c << bits * (n - i) for i, c in enumerate(poly)]
    positive = roots_above(fine, 0)
    out: list[tuple[int, int]] = []
    seen, high = 0, trace << bits
    while seen < min(most, positive):
        low = 0  # more than `seen` roots above low, no more than that above high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if roots_above(fine, mid) > seen else (low, mid)
        upto = roots_above(fine, high - 1)
        out.append((high, upto - seen))
        seen, high = upto, high - 1
    return out, bits


def null_space(matrix: list[list[int]], root: Decimal, times: int) -> list[list[Decimal]]:
    """Unit vectors, at right angles, that matrix - root takes to nothing."""
    n = len(matrix)
    with localcontext() as c:
        c.prec = DIGITS
        a = [[Decimal(x) for x in row] for row in matrix]
        for i in range(n):
            a[i][i] -= root
        order, least = list(range(n)), Decimal(10) ** -DIGITS
        for k in range(n):  # LU with the largest pivot of a column
            i = max(range(k, n), key=lambda r: abs(a[r][k]))
            a[i], a[k], order[i], order[k] = a[k], a[i], order[k], order[i]
            a[k][k] = a[k][k] or least
            pivot = a[k]
            for r in range(k + 1, n):
                row = a[r]
                if row[k]:
                    f = row[k] = row[k] / pivot[k]
                    for j in range(k + 1, n):
                        row[j] -= f * pivot[j]
        basis = [[Decimal((i * 7919 + r * 104729 + i * i * (r + 1)) % 1009 + 1) for i in range(n)] for r in range(times)]
        for _ in range(3):
            turned: list[list[Decimal]] = []
            for start in basis:
                x = [start[i] for i in order]
                for i in range(n):
                    x[i] -= sum(a[i][j] * x[j] for j in range(i))
                for i in range(n - 1, -1, -1):
                    x[i] = (x[i] - sum(a[i][j] * x[j] for j in range(i + 1, n))) / a[i][i]
                size = max(map(abs, x))
                x = [v / size for v in x]
                for _again in range(2):
                    for done in turned:
                        f = sum(p * q for p, q in zip(done, x, strict=True))
                        x = [q - f * p for p, q in zip(done, x, strict=True)]
                size = sum(v * v for v in x).sqrt()
                turned.append([v / size for v in x])
            basis = turned
        return basis


def _components(matrix: list[list[int]], bits: int):
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, m, times in zip(*(batch.column(c).to_pylist() for c in ("place", "m", "times")), strict=True):
                with localcontext() as c:
                    c.prec = DIGITS
                    root = (Decimal(m) - Decimal("0.5")) / (1 << bits)
                vectors = [[str(x) for x in v] for v in null_space(matrix, root, times)]
                yield pa.RecordBatch.from_arrays([pa.array([place] * times, pa.int32()), pa.array([str(root)] * times), pa.array(vectors)], ["place", "root", "v"])

    return solve


@dataclass
class Whitening:
    """n vectors, their sums, and for each component: what (n y - S) is
    multiplied with (None without variance) and its share of the variance."""

    n: int
    sums: list[int]
    factors: list[list[float] | None]
    explained: list[float]
    identity_error: float | None


def fitted(spark: SparkSession, n: int, sums: list[int], matrix: list[list[int]], most: int = COMPONENTS) -> Whitening:
    """Components of a scatter, by falling variance."""
    dims, trace = len(sums), sum(matrix[i][i] for i in range(len(sums)))
    found, bits = largest_roots(charpoly(spark, matrix), trace, min(most, dims))
    asked = [(i, str(m), k) for i, (m, k) in enumerate(found)]
    rows = []
    if asked:
        dealt = spark.createDataFrame(asked, "place int, m string, times int").repartition(len(asked))
        rows = sorted(dealt.mapInArrow(_components(matrix, bits), "place int, root string, v array<string>").collect(), key=lambda r: r.place)[:most]
    with localcontext() as c:
        c.prec = DIGITS
        factors, explained = [], []
        for row in rows:
            root, v = Decimal(row.root), [Decimal(x) for x in row.v]
            v = [x * (1 if max(v, key=abs) > 0 else -1) for x in v]
            factors.append([float(x / root.sqrt()) for x in v])
            explained.append(float(root / trace))
        exact = [[Decimal(x) for x in f] for f in factors]
        halfway = [[sum(Decimal(m) * x for m, x in zip(line, f, strict=True)) for line in matrix] for f in exact]
        errors = [abs(sum(x * y for x, y in zip(f, g, strict=True)) - (i == j)) for i, f in enumerate(exact) for j, g in enumerate(halfway)]
    empty = min(most, dims) - len(rows)
    return Whitening(n, sums, factors + [None] * empty, explained + [0.0] * empty, float(max(errors)) if errors else None)


def deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum((n y - S)^2) of each row, exactly; None if a long cannot hold it."""
    bound = (n * int(np.abs(y).max(initial=0)) + max(map(abs, sums))) ** 2 * y.shape[1]
    kind = np.int64 if bound < MOST else object
    gap = y.astype(kind) * n - np.array(sums, kind)
    return [int(x) if x < 1 << 63 else None for x in (gap * gap).sum(1)]


def whitened(good: DataFrame, model: Whitening, name: str) -> DataFrame:
    """One row a vector and component."""
    dims, k = len(model.sums), len(model.factors)
    weights = np.array([f or [np.nan] * dims for f in model.factors])
    kind = good.schema["key"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                y = integers(batch.column("v"), dims)
                centred = (y.astype(object) * model.n - np.array(model.sums, object)).astype(np.float64) if model.n * (2 * int(np.abs(y).max()) + 1) >= MOST else (y * model.n - np.array(model.sums, np.int64)).astype(np.float64)
                out = np.zeros((len(y), k))
                for j in range(dims):  # always in this order: the sums do not depend on the batch
                    out += centred[:, j : j + 1] * weights[:, j]
                rows = pa.array(np.repeat(np.arange(len(y)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(rows),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                        pa.array([model.n] * (len(y) * k), pa.int64()),
                        pa.array(deviations(y, model.n, model.sums), pa.int64()).take(rows),
                        pa.array(out.ravel(), mask=np.isnan(out.ravel())),
                        pa.array(np.tile(model.explained, len(y))),
                        pa.array([model.identity_error] * (len(y) * k), pa.float64()),
                    ],
                    [name, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return good.mapInArrow(project, f"`{name}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened_embeddings(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error of all usable vectors.

    Left out are vectors that are null, empty, hold a null or a number that is
    not finite, or are shorter than the longest (what is missing is null).
    Entries beyond 2^52 in size are taken as that. Repeated rows and null keys
    count as rows of their own. A component without variance (fewer vectors or
    dimensions than components, constant or repeated columns) has whitened null
    and explained 0; components above the number of dimensions do not exist.
    A deviation above the longs is null. No usable vector gives an empty table.
    """
    good = usable(vectors, key, column)
    dims = good.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return good.select(
            F.col("key").alias(key), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")],
        )
    good = good.where(F.size("v") == dims)
    return whitened(good, fitted(vectors.sparkSession, *scatter(good, dims), most), key)
