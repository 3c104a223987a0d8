"""Whitening of embeddings: leading eigenpairs of their covariance by spectrum slicing.

Spark sums the covariance of the distinct vectors exactly, in integers; only this matrix of the dimension squared reaches the driver. There
the number of negative pivots of the LDL' factors of (V - s I) counts the eigenvalues below s. Halving an interval by such counts isolates
each leading eigenvalue, Rayleigh quotient iteration started in the interval converges to it, and a last pair of counts on both sides of
the result certifies its number. Spark then projects every row.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import written

SCALE = 256
_LIMIT = 2**62


def pivots(a: np.ndarray) -> list[np.ndarray]:
    """The diagonal blocks (1x1 and 2x2) of D in P A P' = L D L' of a symmetric matrix, with complete pivoting."""
    a = a.copy()
    out = []
    while n := len(a):
        i = int(np.argmax(np.abs(np.diag(a))))
        off = np.abs(a - np.diag(np.diag(a)))
        r, c = divmod(int(np.argmax(off)), n)
        if off[r, c] == 0 and a[i, i] == 0:
            return out + [np.zeros((1, 1))] * n
        take = [i] if abs(a[i, i]) >= 0.6403882032022076 * off[r, c] else [r, c]
        rest = np.setdiff1d(np.arange(n), take)
        block, side = a[np.ix_(take, take)], a[np.ix_(rest, take)]
        out.append(block)
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return out


def count_below(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of v are less than shift, by the inertia of v - shift I."""
    below = 0
    for block in pivots(v - shift * np.eye(len(v))):
        if len(block) == 1:
            below += block[0, 0] < 0
        else:  # complete pivoting takes a 2x2 block only where its determinant is negative: one eigenvalue on each side
            det = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            below += 1 if det < 0 else 2 * (block[0, 0] < 0)
    return int(below)


def leading(v: np.ndarray, k: int) -> list[tuple[float, np.ndarray]]:
    """The k largest eigenvalues of a symmetric positive semidefinite matrix with unit eigenvectors, falling.

    Equal eigenvalues, or such that rounding can't tell apart, are one cluster: its vectors are any orthonormal basis. Numbers are
    certified by counts; an eigenvalue that the iteration would miss raises ArithmeticError."""
    n = len(v)
    k = min(k, n)
    norm = float(np.abs(v).sum(axis=1).max()) if n else 0.0
    if norm == 0:
        return [(0.0, np.eye(n)[i]) for i in range(k)]
    tiny = 64 * n * np.finfo(float).eps * norm
    counted: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in counted:
            counted[s] = n - count_below(v, s)
        return counted[s]

    found: list[tuple[float, np.ndarray]] = []
    rng = np.random.default_rng(0)
    while len(found) < k:
        j = len(found)  # the interval (lo, hi] holds the (j+1)-th largest eigenvalue: above(lo) > j >= above(hi)
        lo, hi = -tiny, norm + tiny
        for s, m in counted.items():
            lo, hi = (max(lo, s), hi) if m > j else (lo, min(hi, s))
        while (above(lo) - above(hi) > 1 or hi - lo > 0.25 * max(hi, tiny)) and hi - lo > tiny:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if above(mid) > j else (lo, mid)
        pair = None
        while pair is None:  # orthogonal to those found, which matters for equal eigenvalues
            pair = _rayleigh(v, lo, hi, tiny, rng.standard_normal(n), [x for _, x in found])
            if pair is None:  # it went to an eigenvalue outside: halve the interval again
                if hi - lo <= tiny:
                    raise ArithmeticError("an isolated eigenvalue was not reached")
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if above(mid) > j else (lo, mid)
        value, vector = pair
        if not above(value - tiny) > j >= above(value + tiny):
            raise ArithmeticError("the counts contradict the number of an eigenvalue")
        found.append((value, vector))
    return found


def _rayleigh(v: np.ndarray, lo: float, hi: float, tiny: float, x: np.ndarray, against: list[np.ndarray]) -> tuple[float, np.ndarray] | None:
    """The eigenpair in (lo, hi] by two steps of inverse iteration at its middle, then Rayleigh quotient iteration; None if it leaves."""
    n = len(v)

    def clean(y):
        for _ in range(2):
            for b in against:
                y = y - (b @ y) * b
        return y / np.linalg.norm(y)

    def solved(shift, y):
        try:
            z = np.linalg.solve(v - shift * np.eye(n), y)
        except np.linalg.LinAlgError:
            z = np.linalg.solve(v - (shift + tiny / 64) * np.eye(n), y)
        return clean(z) if np.isfinite(z).all() and z.any() else y

    x = clean(x)
    for _ in range(2):
        x = solved((lo + hi) / 2, x)
    best, value = None, 0.0
    for _ in range(40):
        value = float(x @ v @ x)
        rest = float(np.linalg.norm(v @ x - value * x))
        if best is None or rest < best[0]:
            best = (rest, value, x)
        elif best[0] <= tiny:  # no step makes it smaller
            break
        x = solved(value, x)
    rest, value, x = best
    return (value, x) if rest <= tiny and lo - tiny <= value <= hi + tiny else None


def _matrix(batch_column: pa.Array, d: int) -> np.ndarray:
    return batch_column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def whiten(df: DataFrame, components: int = 4, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and leading component.

    Entries c become x = floor(256 * c). The covariance V, with divisor n, is that of the distinct x-vectors. Rows whose vector is null or
    holds null, NaN or infinite entries are left out, as are those whose length is not the commonest one (of equally common ones the
    longest). Rows of one vec_id stay each by itself, so does a null vec_id. No usable row gives no rows. A component without variance
    (an eigenvalue of no more than rounding) has null as whitened and takes no part in identity_error, which is null if no component has
    variance; explained is null if V is zero. deviation is null where it exceeds a long. Entries beyond 2^55 / 256 saturate as Spark's
    floor does. The fit reads all rows; sums are exact while n * max|x|^2 < 2^62, else doubles.
    """
    spark = df.sparkSession
    c = F.col(f"`{vector}`")
    usable = df.select(F.col(f"`{key}`").alias("vec_id"), c.cast("array<double>").alias("c")).where(
        F.col("c").isNotNull() & F.forall("c", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    sizes = usable.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sizes is None or sizes.d == 0:
        return spark.createDataFrame([], schema)
    d = sizes.d
    rows = usable.where(F.size("c") == d).select("vec_id", F.transform("c", lambda x: F.floor(x * SCALE).cast("long")).alias("x"))
    fit = written(rows.select("x").distinct())

    def totals(batches):
        count, total, most = 0, np.zeros(d, object), 0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), d)
                count, total = count + len(x), total + (x >> 20).sum(axis=0).astype(object) * 2**20 + (x & (2**20 - 1)).sum(axis=0).astype(object)
                most = max(most, -int(x.min()), int(x.max()))
        if count:
            yield pa.RecordBatch.from_pydict({"n": [count], "most": [float(most)], "s": [[str(t) for t in total]]}, pa.schema([("n", pa.int64()), ("most", pa.float64()), ("s", pa.list_(pa.string()))]))

    parts = fit.mapInArrow(totals, "n long, most double, s array<string>")
    sums = parts.select("n", "most", F.posexplode("s")).groupBy("pos").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()
    n, most, s = sums[0].n, sums[0].most, [int(r.s) for r in sums]
    near = [(2 * t + n) // (2 * n) for t in s]  # the mean to the nearest integer: vectors are centred by it before they are multiplied
    shift, exact = np.array(near), n * (2 * int(most)) ** 2 < _LIMIT
    mean = np.array([float(Fraction(t, n)) for t in s])

    def products(batches):
        total = np.zeros((d, d), np.int64 if exact else float)
        step = max(1, int(2**52 // max(1, (2 * most) ** 2))) if exact else 4096
        for b in batches:
            x = _matrix(b.column(0), d)
            for lo in range(0, len(x), step):
                y = (x[lo : lo + step] - shift).astype(float) if exact else x[lo : lo + step] - mean
                g = y.T @ y  # of integers: exact below 2^53
                total += g.astype(np.int64) if exact else g
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(total))], ["i", "row"])

    kind = "long" if exact else "double"
    grams = fit.mapInArrow(products, f"i long, row array<{kind}>").select("i", F.posexplode("row").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g"))
    gram = np.zeros((d, d), object if exact else float)
    for r in grams.collect():  # one row for each pair of dimensions, whatever the number of vectors
        gram[r.i, r.j] = r.g
    left = [t - n * m for t, m in zip(s, near, strict=True)]
    v = np.array([[float(Fraction(n * int(gram[i, j]) - left[i] * left[j], n * n)) for j in range(d)] for i in range(d)]) if exact else (gram + gram.T) / (2 * n)

    trace = float(np.trace(v))
    pairs = leading(v, components)
    noise = 64 * d * np.finfo(float).eps * trace
    scale = [1 / np.sqrt(e) if e > noise else 0.0 for e, _ in pairs]
    explained = [max(e, 0.0) / trace if trace else None for e, _ in pairs]
    axes, good = np.stack([x for _, x in pairs], axis=1) * np.array(scale), np.array(scale) > 0
    k, offset = len(pairs), np.array([float(Fraction(t - n * m, n)) for t, m in zip(s, near, strict=True)])

    def projected(x):
        return ((x - shift).astype(float) - offset) @ axes

    def moments(batches):
        total, first, count = np.zeros((k, k)), np.zeros(k), 0
        for b in batches:
            if b.num_rows:
                w = projected(_matrix(b.column(0), d))
                total, first, count = total + w.T @ w, first + w.sum(axis=0), count + len(w)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()]), pa.array([first])], ["m", "f"])

    seen = fit.mapInArrow(moments, "m array<double>, f array<double>")
    second = {r.pos: r.t for r in seen.select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("t")).collect()}
    first = {r.pos: r.t for r in seen.select(F.posexplode("f")).groupBy("pos").agg(F.sum("col").alias("t")).collect()}
    m = np.array([first[i] for i in range(k)]) / n
    cov = np.array([[second[i * k + j] for j in range(k)] for i in range(k)]) / n - np.outer(m, m)
    error = float(np.abs(cov - np.eye(k))[np.ix_(good, good)].max()) if good.any() else None
    small = n * 2 * most < 2**31 and d * (n * 2 * most) ** 2 < _LIMIT
    total = np.array(s) if small else np.array(s, object)

    def out(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), d)
            w = projected(x)
            if small:
                deviation = pa.array(((n * x - total) ** 2).sum(axis=1))
            else:
                deviation = pa.array([t if t < 2**63 else None for t in ((n * x.astype(object) - total) ** 2).sum(axis=1)], pa.int64())
            row, part = np.repeat(np.arange(len(x)), k), np.tile(np.arange(k), len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(row)), pa.array((part + 1).astype(np.int32)), pa.array(np.full(len(row), n)), deviation.take(pa.array(row)), pa.array(w.ravel(), mask=~good[part]),
                    pa.array(explained, pa.float64()).take(pa.array(part)), pa.array([error] * len(row), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(out, schema)
