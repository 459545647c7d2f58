"""Whitening of vectors by the exact characteristic polynomial of their integer scatter.

Components become integers, so the scatter matrix A = n * sum(x x') - S S' of
the distinct vectors (n^2 times their covariance) is exact. Its characteristic
polynomial is found modulo many primes by Hessenberg reduction, as Spark tasks,
and put together by Chinese remaindering. All roots are real, so the sign
changes of the shifted polynomial count the roots above any point exactly;
bisection isolates the largest ones. Their vectors come from inverse iteration
on A - e, in decimals of many digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakelane.llm.common import gathered, written

#: Entries become floor(SCALE * entry); so many components are reported.
SCALE, COMPONENTS = 256, 4
#: Roots are isolated to this share of themselves, in bits; vectors are solved with this many digits.
ROOT_BITS, DIGITS = 160, 90
#: Primes of one task; all are below 2^31, so that products of residues fit a long.
PRIMES_A_TASK = 16
#: Products below this are exact in double precision; larger entries are split into limbs of so many bits.
EXACT, LIMB = 1 << 53, 21
#: Values beyond a long are held at its ends.
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Neither null nor empty, no null and no non-finite entry."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def integers(vectors: pa.Array, scale: int = SCALE) -> np.ndarray:
    """floor(scale * entry) of a batch of vectors of one length, as longs."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(scale * flat)
    inside = (whole >= -(2.0**63)) & (whole < 2.0**63)
    out = np.where(inside, whole, 0).astype(np.int64)
    out[whole >= 2.0**63], out[whole < -(2.0**63)] = HIGH, LOW
    return out.reshape(len(vectors), -1)


def largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def column_sums(x: np.ndarray) -> np.ndarray:
    """Sums of columns in exact integers."""
    return (x if largest(x) * max(len(x), 1) < HIGH else x.astype(object)).sum(0).astype(object)


def gram(x: np.ndarray) -> np.ndarray:
    """x' x in exact integers, by double-precision products of limbs small enough to be exact."""
    top = largest(x)
    if top * top * max(len(x), 1) < EXACT:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if len(x) > 1 << 53 - 2 * LIMB - 1:
        half = len(x) // 2
        return gram(x[:half]) + gram(x[half:])
    size, sign = np.abs(x.astype(object)), np.sign(x)
    limbs = [((size >> LIMB * i) & ((1 << LIMB) - 1)).astype(np.float64) * sign for i in range(-(-top.bit_length() // LIMB))]
    return sum((a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j) for i, a in enumerate(limbs) for j, b in enumerate(limbs))


@dataclass
class Moments:
    """n, sums and sums of products of the fit list, exact."""

    n: int
    sums: list[int]
    products: np.ndarray

    def scatter(self) -> np.ndarray:
        s = np.array(self.sums, object)
        return self.n * self.products - np.outer(s, s)


def moments(fit: DataFrame, d: int) -> Moments:
    """Exact moments of x (array<long>): a partial d x d matrix per task, summed by matrix rows in Spark; d rows come back.

    Rows travel as decimal text, as sums may pass any fixed width.
    """

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for b in gathered(batches):
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            n, sums, products = n + len(x), sums + column_sums(x), products + gram(x)
        if n:
            rows = [" ".join(map(str, r)) for r in products.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(list(map(str, sums))), pa.array(rows)], names=["i", "n", "s", "row"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sum(np.array([int(v) for v in r.split()], object) for r in pdf["row"])
        return pd.DataFrame({"i": pdf.i[:1], "n": [int(pdf.n.sum())], "s": [str(sum(map(int, pdf.s)))], "row": [" ".join(map(str, rows))]})

    schema = "i int, n long, s string, row string"
    found = fit.select("x").mapInArrow(partial, schema).groupBy("i").applyInPandas(total, schema).collect()
    found.sort(key=lambda r: r["i"])
    products = np.array([[int(v) for v in r["row"].split()] for r in found], object).reshape(len(found), -1)
    return Moments(found[0]["n"] if found else 0, [int(r["s"]) for r in found], products)


def prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 3.2e9."""
    if n < 2 or n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if base % n and x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes below 2^31, from the top, whose product has more than so many bits."""
    out, p, have = [], (1 << 31) - 1, 0.0
    while have <= bits + 1:
        if prime(p):
            out.append(p)
            have += math.log2(p)
        p -= 2
    return out


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo p with zeros below the first subdiagonal, by row and column operations."""
    a, d = a.copy(), len(a)
    for k in range(1, d - 1):
        below = np.flatnonzero(a[k:, k - 1])
        if not len(below):
            continue
        pivot = k + below[0]
        a[[k, pivot]] = a[[pivot, k]]
        a[:, [k, pivot]] = a[:, [pivot, k]]
        ratio = a[k + 1 :, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1 :] = (a[k + 1 :] - ratio[:, None] * a[k][None] % p) % p
        # The inverse operation on columns keeps the matrix similar.
        a[:, k] = (a[:, k] + (a[:, k + 1 :] * ratio % p).sum(1)) % p
    return a


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - A) modulo p, constant term first, from the Hessenberg form's recurrence."""
    h, d = hessenberg(a, p), len(a)
    rows = [np.zeros(d + 1, np.int64)]
    rows[0][0] = 1
    for k in range(1, d + 1):
        q = np.zeros(d + 1, np.int64)
        q[1:] = rows[-1][:-1]
        q = (q - int(h[k - 1, k - 1]) * rows[-1] % p) % p
        below = 1
        for i in range(1, k):
            below = below * int(h[k - i, k - i - 1]) % p
            if not below:
                break
            q = (q - int(h[k - i - 1, k - 1]) * below % p * rows[k - i - 1] % p) % p
        rows.append(q)
    return rows[-1].tolist()


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Exact coefficients of det(t - A), constant term first, of a positive semidefinite integer matrix.

    The sizes of coefficients are bounded by the trace (Maclaurin's inequality),
    which fixes how many primes there are; each is a task's work. The matrix
    goes along as text and only residues come back.
    """
    d = len(a)
    trace = int(sum(a.diagonal()))
    if not trace:
        return [0] * d + [1]
    most = max(math.lgamma(d + 1) / math.log(2) - (math.lgamma(k + 1) + math.lgamma(d - k + 1)) / math.log(2) + k * (trace.bit_length() - math.log2(d)) for k in range(d + 1))
    primes = primes_for(int(most) + 2)
    text = [[str(v) for v in r] for r in a.tolist()]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.array([[int(v) for v in r] for r in text], object)
        for pdf in frames:
            yield pd.DataFrame({"p": pdf.p, "c": [polynomial_mod((whole % p).astype(np.int64), p) for p in pdf.p.tolist()]})

    tasks = max(1, -(-len(primes) // PRIMES_A_TASK))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInPandas(run, "p long, c array<long>").collect()
    modulus, value = 1, [0] * (d + 1)
    for r in sorted(rows, key=lambda r: r["p"]):
        p, inverse = r["p"], pow(modulus % r["p"], -1, r["p"]) if modulus > 1 else 1
        value = [v + modulus * ((c - v) * inverse % p) for v, c in zip(value, r["c"])]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in value]


def roots_above(c: list[int], at: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only lie above at / 2^bits, each by its multiplicity.

    That is the number of sign changes of the polynomial shifted there.
    """
    d = len(c) - 1
    s = [v << (bits * (d - i)) for i, v in enumerate(c)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            s[j] += at * s[j + 1]
    signs = [v > 0 for v in s if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(c: list[int], k: int, top: int) -> list[Decimal]:
    """The k largest positive roots by falling size, each as often as its multiplicity, to ROOT_BITS bits of itself.

    Bisection on integers until a root is alone or known to a few bits more
    than a double; a root alone is then drawn in by the polynomial's sign.
    """
    out = []
    known: dict[tuple[int, int], int] = {}

    def above(at: int, bits: int) -> int:
        while bits and not at & 1:
            at, bits = at >> 1, bits - 1
        if (at, bits) not in known:
            known[at, bits] = roots_above(c, at, bits)
        return known[at, bits]

    def sign(at: int, bits: int) -> int:
        v = 0
        for i, x in enumerate(reversed(c)):
            v = v * at + (x << (bits * i))
        return (v > 0) - (v < 0)

    for r in range(1, k + 1):
        if above(0, 0) < r:
            break
        lo, hi, bits = 0, 1 << top.bit_length(), 0  # root number r lies in (lo, hi]
        alone = False
        while lo == 0 or (hi - lo) << ROOT_BITS > lo:
            if hi - lo == 1:
                lo, hi, bits = 2 * lo, 2 * hi, bits + 1
            mid = (lo + hi) // 2
            alone = alone or (above(lo, bits) == r and above(hi, bits) == r - 1)
            if alone:  # one simple root between: right of the mid where the sign there is that of the left end
                at = sign(mid, bits)
                right = at != 0 and at == (-1 if r % 2 else 1)
            else:
                right = above(mid, bits) >= r
            lo, hi = (mid, hi) if right else (lo, mid)
        with localcontext() as ctx:
            ctx.prec = DIGITS
            out.append((Decimal(lo) + Decimal(hi)) / 2 / Decimal(2) ** bits)
    return out


def null_vector(a: np.ndarray, e: Decimal, earlier: list[list[Decimal]], number: int) -> list[Decimal]:
    """Unit vector v with A v = e v, orthogonal to earlier ones, by inverse iteration on A - e."""
    d = len(a)
    with localcontext() as ctx:
        ctx.prec = DIGITS
        m = [[Decimal(int(v)) for v in r] for r in a.tolist()]
        tiny = max(e, Decimal(1)) * Decimal(10) ** -(DIGITS - 10)
        for i in range(d):
            m[i][i] -= e
        swaps = []
        for k in range(d):  # elimination with row exchange; factors stay below the diagonal
            pivot = max(range(k, d), key=lambda i: abs(m[i][k]))
            m[k], m[pivot] = m[pivot], m[k]
            swaps.append(pivot)
            if abs(m[k][k]) < tiny:
                m[k][k] = tiny
            for i in range(k + 1, d):
                f = m[i][k] / m[k][k]
                m[i][k] = f
                if f:
                    row, head = m[i], m[k]
                    for j in range(k + 1, d):
                        row[j] -= f * head[j]

        def unit(v: list[Decimal]) -> list[Decimal]:
            for w in earlier:
                dot = sum(x * y for x, y in zip(v, w))
                v = [x - dot * y for x, y in zip(v, w)]
            size = sum(x * x for x in v).sqrt()
            return [x / size for x in v]

        v = unit([Decimal((37 * i * i + 101 * i * number + 11 * number) % 97 + 1) for i in range(d)])
        for _ in range(3):
            for k in range(d):
                v[k], v[swaps[k]] = v[swaps[k]], v[k]
            for k in range(d):
                for i in range(k + 1, d):
                    v[i] -= m[i][k] * v[k]
            for k in range(d - 1, -1, -1):
                v[k] = (v[k] - sum(m[k][j] * v[j] for j in range(k + 1, d))) / m[k][k]
            v = unit(v)
        return v


@dataclass
class Whitening:
    """A fitted model: n, sums, components (rows) and, for each, its eigenvalue of the covariance and share of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: list[float]
    explained: list[float]


def fit(x: DataFrame, d: int, k: int = COMPONENTS) -> Whitening:
    """Model of the distinct vectors x (array<long> of d entries); components with an eigenvalue above 0, at most k."""
    m = moments(x, d)
    if not m.n:
        return Whitening(0, [0] * d, np.zeros((0, d)), [], [])
    a = m.scatter()
    trace = int(sum(a.diagonal()))
    # Divided by what all entries share, coefficients are smaller and components the same.
    share = math.gcd(*(int(v) for v in a.ravel())) or 1
    small = a // share
    roots = largest_roots(characteristic_polynomial(x.sparkSession, small), k, trace // share) if trace else []
    vectors: list[list[Decimal]] = []
    for i, e in enumerate(roots):
        vectors.append(null_vector(small, e, vectors, i + 1))
    with localcontext() as ctx:
        ctx.prec = DIGITS
        values = [float(e * share / (Decimal(m.n) * m.n)) for e in roots]
        explained = [float(e * share / trace) for e in roots]
    return Whitening(m.n, m.sums, np.array([[float(c) for c in v] for v in vectors]).reshape(len(roots), d), values, explained)


def projected(model: Whitening, x: np.ndarray) -> np.ndarray:
    """Whitened coordinates of integer vectors, one column per component."""
    mean = np.array([s / model.n for s in model.sums])
    scale = np.array([math.sqrt(e) for e in model.eigenvalues])
    return (x - mean) @ model.components.T / scale


def deviations(model: Whitening, x: np.ndarray) -> list[int | None]:
    """sum of (n x - S)^2 over entries, exact; null beyond a long."""
    top = model.n * largest(x) + max(map(abs, model.sums), default=0)
    if top * top * x.shape[1] <= HIGH:
        gap = model.n * x - np.array(model.sums, np.int64)
        return (gap * gap).sum(1).tolist()
    gap = model.n * x.astype(object) - np.array(model.sums, object)
    return [v if v <= HIGH else None for v in (gap * gap).sum(1)]


def identity_error(model: Whitening, x: DataFrame, d: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, by Spark's centred covariances."""
    k = len(model.eigenvalues)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            w = projected(model, b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=[f"w{i}" for i in range(k)])

    if not k:
        return None
    rows = x.select("x").mapInArrow(run, ", ".join(f"w{i} double" for i in range(k)))
    entries = [F.abs(F.covar_pop(f"w{i}", f"w{j}") - float(i == j)) for i in range(k) for j in range(i, k)]
    return rows.agg(F.greatest(*entries, F.lit(0.0)).alias("e")).first()["e"]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error of each usable row and component.

    Rows whose vector is null, empty, or holds a null or non-finite entry take
    no part, nor do those of another length than the most frequent one (ties:
    the longer). Repeated rows and null ids come out as they came in; equal
    vectors count once in the fit. Entries beyond a long are held at its ends; a
    deviation beyond a long is null. There are as many components as positive
    eigenvalues, at most k: none, and so no rows, where all vectors are equal.
    Where eigenvalues are equal, any basis of their space is returned. Extra
    columns are left out.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(usable(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    d = sizes["d"]
    rows = rows.where(F.size("vec") == d)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            x = integers(b.column(0), scale)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * d, pa.array(x.ravel()))], names=["x"])

    distinct = written(rows.select("vec").mapInArrow(whole, "x array<long>").distinct(), "whitening-fit")
    model = fit(distinct, d, k)
    error = identity_error(model, distinct, d)
    names = [x.split()[0] for x in schema.split(", ")]
    count = len(model.eigenvalues)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            x = integers(b.column(1), scale)
            m = len(x) * count
            take = pa.array(np.repeat(np.arange(len(x)), count))
            wide = [pa.array(deviations(model, x), pa.int64()).take(take), pa.array(projected(model, x).ravel()), pa.array(np.tile(model.explained, len(x)))]
            columns = [b.column(0).take(take), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()), pa.array(np.full(m, model.n), pa.int64()), *wide, pa.array(np.full(m, error))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    if not count:
        return spark.createDataFrame([], schema)
    return rows.mapInArrow(run, schema)
