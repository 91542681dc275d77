"""Operator 12, embedding whitening by a bidiagonal qd solver.

Vectors are made whole numbers, so their sums are exact. Centred rows are reduced block by block to a triangle R each, and
triangles by QR again, a bounded number at a time, until one is left: R'R is n times the covariance, which is never formed. Householder
reflections make R bidiagonal. Its singular values come from dqds, which works on squares of the entries without subtractions that cancel, so small ones
are as accurate as large ones. A vector of the bidiagonal's Gram matrix comes from its two factorisations with the value
taken off, from the top and from the bottom, twisted together where they meet with the least remainder; values that are nearly the same get
theirs by inverse iteration beside each other. Directions, reflected back and divided by their deviations, whiten the rows.

What is no longer a matter of rows (a triangle as wide as a vector) is solved by the driver; all else is done in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import stored

#: Rows of a block that is reduced at once, and triangles (or moments) that a task takes together.
BLOCK, FAN = 4096, 32
#: What x = floor(SCALE * c) + SHIFT makes of an entry.
SCALE, SHIFT = 1024, 100_000
_EPS = float(np.finfo(float).eps)


# ------------------------------------------------------------------ the solver, on matrices as wide as a vector


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, V): r = U B V' with B upper bidiagonal, a its diagonal and b what stands beside, by Householder reflections."""
    r, n = np.array(r, float), len(r)
    v = np.eye(n)

    def reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
        """u with |u|^2 = 2 (or 0) so that x - u (u'x) is (value, 0, ...)."""
        size = np.abs(x).max(initial=0.0)
        if size == 0 or not np.abs(x[1:]).max(initial=0.0):
            return np.zeros_like(x), float(x[0]) if len(x) else 0.0
        u = x / size
        value = -math.copysign(float(np.linalg.norm(u)), u[0])
        u[0] -= value
        return u * (math.sqrt(2) / np.linalg.norm(u)), value * size

    a, b = np.zeros(n), np.zeros(max(0, n - 1))
    for k in range(n):
        u, a[k] = reflection(r[k:, k])
        r[k:, k:] -= np.outer(u, u @ r[k:, k:])
        if k < n - 1:
            u, b[k] = reflection(r[k, k + 1 :])
            r[k:, k + 1 :] -= np.outer(r[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ u, u)
    return a, b, v


def below(q: list[float], e: list[float]) -> float:
    """No more than the least value of a qd array: the reciprocals of what a sweep without shift leaves on its way are the diagonal of the inverse, and
    their sum is more than the reciprocal of the least value."""
    d, total = q[0], 0.0
    for k in range(len(q)):
        if d <= 0:
            return 0.0
        total += 1 / d
        if k < len(q) - 1:
            d = d * (q[k + 1] / (d + e[k]))
    return (1 - 4 * len(q) * _EPS) / total


def swept(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], bool]:
    """One differential qd sweep with a shift, and whether all values are above it."""
    n, d, good = len(q), q[0] - shift, True
    q2, e2 = [0.0] * n, [0.0] * n
    for k in range(n - 1):
        good = good and d >= 0
        q2[k] = d + e[k]
        t = q[k + 1] / q2[k] if q2[k] else 0.0
        e2[k], d = e[k] * t, d * t - shift
    q2[n - 1] = d
    return q2, e2, good and d >= 0


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling. Sweeps are shifted towards the least value that is left: by a guess from the
    last two entries where these have nearly come apart, and if that is too much by what is surely below it."""
    done: list[float] = []
    work = [((np.asarray(a, float) ** 2).tolist(), [*(np.asarray(b, float) ** 2).tolist(), 0.0], 0.0)]
    while work:
        q, e, taken = work.pop()
        left = 100 * len(q) + 1000
        while q:
            n = len(q)
            if n == 1:
                done.append(q[0] + taken)
                break
            if e[n - 2] <= _EPS**2 * (taken + q[n - 1]) or e[n - 2] == 0:
                done.append(q.pop() + taken)
                e.pop()
                e[-1] = 0.0
                continue
            cut = next((k for k in range(n - 2, 0, -1) if e[k - 1] <= _EPS**2 * (taken + min(q[k - 1], q[k])) or e[k - 1] == 0), 0)
            if cut:
                work.append((q[:cut], [*e[: cut - 1], 0.0], taken))
                q, e = q[cut:], e[cut:]
                continue
            left -= 1
            if not left:
                raise ArithmeticError("dqds did not converge")
            if 1.5 * q[0] < q[-1]:  # small values are found at the end
                q, e = q[::-1], [*e[-2::-1], 0.0]
            x, y, z = q[n - 2], q[n - 1], e[n - 2]
            guess = 0.0
            if z < 0.1 * x and y < x:
                guess = 2 * x * y / (x + y + z + math.sqrt(max((x + y + z) ** 2 - 4 * x * y, 0.0))) * (1 - math.sqrt(z / x))
            for shift in (max(guess, below(q, e)), below(q, e), 0.0):
                q2, e2, good = swept(q, e, shift)
                if good or not shift:
                    break
            q, e, taken = q2, e2, taken + shift
            q[n - 1] = max(q[n - 1], 0.0)
    return np.array(sorted(done, reverse=True))


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The vector of B'B, B bidiagonal, to one of its eigenvalues: z with (B'B - value) z as small as a twist of the two factorisations allows."""
    n = len(a)
    q, e = a**2, np.append(b**2, 0.0)  # B'B = L D L', D = a^2, L has b / a below its diagonal
    link = a[:-1] * b  # entries of B'B beside its diagonal
    tiny = np.finfo(float).tiny / _EPS
    safe = lambda x: x if abs(x) > tiny else tiny
    # from the top: s; from the bottom: p; both as differential qd transforms
    s, plus, p, minus = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    s[0] = -value
    for k in range(n):
        plus[k] = safe(s[k] + q[k])
        if k < n - 1:
            s[k + 1] = (e[k] / plus[k]) * s[k] - value
    p[n - 1] = q[n - 1] - value
    for k in range(n - 2, -1, -1):
        minus[k + 1] = safe(p[k + 1] + e[k])
        p[k] = p[k + 1] * (q[k] / minus[k + 1]) - value
    gamma = s + p + value
    z = np.zeros(n)
    r = int(np.argmin(np.abs(gamma)))
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -link[k] / plus[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -link[k] / minus[k + 1] * z[k]
    norm = np.linalg.norm(z)
    return z / norm if np.isfinite(norm) and norm else z


def beside(a: np.ndarray, b: np.ndarray, value: float, others: list[np.ndarray]) -> np.ndarray:
    """A vector to a value of which `others` have neighbours: inverse iteration with what is theirs taken out each time."""
    gram = np.diag(a**2 + np.append(0.0, b**2)) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    shifted = gram - (value + 8 * _EPS * np.abs(gram).max(initial=0.0)) * np.eye(len(a))
    x = np.random.default_rng(len(others)).normal(size=len(a))
    for _ in range(4):
        for _ in range(2):
            for o in others:
                x = x - o * (o @ x)
        x = np.linalg.solve(shifted, x / np.linalg.norm(x))
    for _ in range(2):
        for o in others:
            x = x - o * (o @ x)
        x = x / np.linalg.norm(x)
    return x


def principal(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, total) of R'R / n: the largest eigenvalues above what rounding leaves of a zero, at most so many, their unit vectors as
    columns, and the sum of all."""
    a, b, v = bidiagonal(r)
    squares = dqds(a, b)
    total = float((a**2).sum() + (b**2).sum())
    limit = (len(a) * _EPS) ** 2 * (squares[0] if len(squares) else 0.0)
    # where b is nothing, the matrix falls apart, and vectors are those of its parts
    size = np.abs(a).max(initial=0.0)
    cuts = [0, *(k + 1 for k in range(len(b)) if abs(b[k]) <= _EPS * size * 1e-3), len(a)]
    found = []
    for low, high in zip(cuts, cuts[1:]):
        part_a, part_b = a[low:high], b[low : high - 1]
        near: list[tuple[float, np.ndarray]] = []
        for value in dqds(part_a, part_b)[:most]:
            if value <= limit or value <= 0:
                continue
            close = [z for w, z in near if w - value <= 1e-3 * w]
            z = twisted(part_a, part_b, value)
            if close and (not np.isfinite(z).all() or max(abs(c @ z) for c in close) > 1e-14 * len(a)):
                z = beside(part_a, part_b, value, close)
            near.append((value, z))
            whole = np.zeros(len(a))
            whole[low:high] = z
            found.append((value, whole))
    found = sorted(found, key=lambda x: -x[0])[:most]
    values = np.array([x[0] for x in found])
    vectors = v @ np.stack([x[1] for x in found], 1) if found else np.zeros((len(a), 0))
    return values / n, vectors, total / n


# ------------------------------------------------------------------ rows, in tasks


def vectors_of(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """rows(vec_id, v) with whole vectors of finite entries, and how long they are."""
    entries = F.transform(vector_col, lambda c: c.cast("double"))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), entries.alias("v"))
    # NaN and the infinities are what is no number when taken from itself
    rows = rows.filter((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ((c - c) == 0)))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    return rows.filter(F.size("v") == (lengths["d"] if lengths else 0)), lengths["d"] if lengths else 0


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The x-vectors of a batch, which are whole numbers."""
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    x = np.floor(v * SCALE)
    if np.abs(x).max(initial=0.0) >= 2.0**53:
        raise ValueError("an entry is too large to be a whole number of 1 / 1024")
    return x.astype(np.int64) + SHIFT


def sums_of(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension: partial sums in tasks, added up as decimals."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = matrix(batch, d)
            for at in range(0, len(x), 256):  # so many of 53 bits stay below 63
                total = [a + int(b) for a, b in zip(total, x[at : at + 256].sum(0))]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), pa.array([str(t) for t in [n, *total]])], names=["dim", "total"])

    added = rows.mapInArrow(add, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["dim"]: int(r["total"]) for r in added.collect()}  # one row for each dimension
    return found.get(-1, 0), [found.get(k, 0) for k in range(d)]


def merged(parts: DataFrame, together, schema: str) -> list[np.ndarray]:
    """parts(k, body), bytes of arrays, taken together FAN at a time, until one is left: together(list) makes one of several."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for body in batch.column("body").to_pylist():
                held.append(body)
                if len(held) == FAN:
                    held = [together(held)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([together(held)], pa.binary())], names=["k", "body"])

    n = parts.count()
    while n > FAN:
        n = -(-n // FAN)
        parts = stored(parts.repartition(n, "k").mapInArrow(some, schema).withColumn("k", F.monotonically_increasing_id()))
        n = parts.count()
    bodies = [bytes(r["body"]) for r in parts.select("body").collect()]  # FAN at most
    return [together(bodies)] if bodies else []


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean, rounded once: the mean's whole part comes off as a whole number."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([float(Fraction(s % n, n)) for s in sums])
    return (x - whole) - rest


def triangle(rows: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """R with R'R the sum of the squares and products of all centred rows, by QR in blocks."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            x = centred(matrix(batch, d), n, sums)
            for at in range(0, len(x), BLOCK):
                r = np.linalg.qr(np.vstack([r, x[at : at + BLOCK]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["k", "body"])

    def together(bodies: list[bytes]) -> bytes:
        return np.linalg.qr(np.vstack([np.frombuffer(b).reshape(-1, d) for b in bodies]), mode="r").tobytes()

    parts = stored(rows.mapInArrow(reduce, "k long, body binary").withColumn("k", F.monotonically_increasing_id()))
    r = np.frombuffer(merged(parts, together, "k long, body binary")[0]).reshape(-1, d)
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each row the exact sum of (n x - S)^2; null where a long does not hold it."""
    low = x - np.array([s // n for s in sums], np.int64)  # n x - S = n * low - (S mod n)
    bound = n * (int(np.abs(low).max(initial=0)) + 1)
    if bound * bound * len(sums) < 2**63:
        y = n * low - np.array([s % n for s in sums], np.int64)
        return (y * y).sum(1).tolist()
    rest = [s % n for s in sums]
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, rest)) for row in low.tolist()]
    return [t if t < 2**63 else None for t in exact]


def moments(white: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean, and sum of products of what differs from it."""
    mean = white.mean(0)
    return len(white), mean, (white - mean).T @ (white - mean)


def joined_moments(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    n, mean, products = parts[0]
    for m, other, more in parts[1:]:
        step = other - mean
        mean, products, n = mean + step * (m / (n + m)), products + more + np.outer(step, step) * (n * m / (n + m)), n + m
    return n, mean, products


def whitened(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and principal component.

    Rows without a vector, or with entries that are null or not finite, go; so do empty vectors and, if lengths differ, all but those of the most
    frequent length (of the longest of several). What remains is the fit list, rows that repeat an id and equal vectors each for itself; a null id is an id
    like any other. Components are numbered by falling eigenvalue, up to `components`; those of which rounding leaves nothing (all of a single vector, or of equal ones)
    have no rows. Vectors of any length have exact sums and deviations; a deviation that no long holds is null. Entries from 2^43 on raise an error. Further columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    rows, d = vectors_of(rows, id_col, vector_col)
    if not d:
        return spark.createDataFrame([], schema)
    n, sums = sums_of(rows, d)
    values, vectors, total = principal(triangle(rows, d, n, sums), n, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    directions, explained = vectors / np.sqrt(values), values / total

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                here = moments(centred(matrix(batch, d), n, sums) @ directions)
                found = here if found is None else joined_moments([found, here])
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([packed(found)], pa.binary())], names=["k", "body"])

    def packed(m: tuple[int, np.ndarray, np.ndarray]) -> bytes:
        return np.concatenate([[m[0]], m[1], m[2].ravel()]).tobytes()

    def unpacked(body: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        a = np.frombuffer(body)
        return int(a[0]), a[1 : k + 1], a[k + 1 :].reshape(k, k)

    parts = stored(rows.mapInArrow(measure, "k long, body binary").withColumn("k", F.monotonically_increasing_id()))
    _, _, products = unpacked(merged(parts, lambda bodies: packed(joined_moments([unpacked(b) for b in bodies])), "k long, body binary")[0])
    error = float(np.abs(products / n - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, d)
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                pa.array(deviations(x, n, sums), pa.int64()).take(each), pa.array((centred(x, n, sums) @ directions).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
