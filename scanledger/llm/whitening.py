"""Embedding whitening: projection on the leading eigenvectors of the covariance, each scaled to variance one.

1. Every entry c becomes the integer x = floor(64 * c) + 1000000. The fit list is each distinct vector x once.
2. Tasks add up the fit list in integers, then the products of its entries centred by their rounded means. Centred
   entries are split in 16-bit limbs, whose float64 products are exact, so the sums over all tasks are exact integers and
   the covariance (n * products - sums * sums) / n**2 does not depend on how rows are dealt.
3. The driver holds that one matrix, whose size follows the dimension alone: Householder reflections make it
   tridiagonal; bisection with Sturm counts finds the leading eigenvalues; inverse iteration finds their vectors, and
   within a cluster of close eigenvalues each is made orthogonal to those before it; reflections carry them back.
4. Mean and components go out in a broadcast, and every row is projected. A last pass over the fit list takes the
   covariance of the projections.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are left out; if vectors differ in
length, those of the most frequent length (of several, the longest) are used and the others left out; components whose
eigenvalue is not above the rounding error of the matrix are left out (all of them, if all vectors are equal); equal
vectors and repeated or null ids each give their rows; components of equal eigenvalues are some orthonormal basis of their
space; an eigenvector's largest entry is positive; a deviation beyond the range of a long is null; an empty table gives
an empty one; only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanledger.llm import common as C

#: The driver holds two matrices of this many rows and columns at most (2 x 134 MB).
MOST_DIMENSIONS = 4096
#: Bits of a limb, limbs of a 64-bit difference, and rows whose limb products add up without rounding.
LIMB, LIMBS, ROWS = 16, 5, 1 << 14
#: Parts in which the rows of the product matrix are added up.
PARTS = 16


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """The lists of a column, all of one length, as a matrix."""
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(len(column), -1)


def _sums(batches):
    """Per dimension: the sum of the high and of the low 32 bits of this task's vectors, and their number."""
    n, high, low = 0, 0, 0
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("x"))
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
    if n:
        at = np.arange(len(high))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (at, np.full(len(at), n), high, low)], names=["at", "n", "high", "low"])


def limbs(z: np.ndarray) -> list[np.ndarray]:
    """Signed 16-bit limbs of the integers, the lowest first, as float64; high limbs that are all 0 are left out."""
    out = []
    while len(out) < LIMBS and (z.any() or not out):
        low = ((z + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
        out.append(low.astype(np.float64))
        z = (z - low) >> LIMB
    return out


def products(z: np.ndarray, held: dict[int, np.ndarray]) -> None:
    """Adds the products of the columns of ``z`` to ``held``: an integer matrix for each power of the limb base."""
    parts = limbs(z)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            held[i + j] = held.get(i + j, 0) + (a.T @ b).astype(np.int64)
    for power in sorted(held):  # carry, so that no sum outgrows 64 bits
        if np.abs(held[power]).max(initial=0) >= 1 << 48:
            carry = held[power] >> LIMB
            held[power] = held[power] - (carry << LIMB)
            held[power + 1] = held.get(power + 1, 0) + carry


_PRODUCT = pa.schema([("part", pa.int32()), ("power", pa.int32()), ("row", pa.int32()), ("sums", pa.binary())])


def _products(batches, centre):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            products(matrix(batch.column("x").slice(start, ROWS)) - centre.value, held)
    for power, sums in held.items():
        for start in range(0, len(sums), 256):
            yield C.arrow(_PRODUCT, [(i % PARTS, power, i, sums[i].tobytes()) for i in range(start, min(len(sums), start + 256))])


def _add(batches):
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, key in enumerate(zip(batch.column("power").to_pylist(), batch.column("row").to_pylist(), strict=True)):
            held[key] = held.get(key, 0) + C.view(batch.column("sums"), i, np.int64)
    rows = [(key[1] % PARTS, *key, sums.tobytes()) for key, sums in held.items()]
    for i in range(0, len(rows), 64):
        yield C.arrow(_PRODUCT, rows[i : i + 64])


def moments(fit: DataFrame) -> tuple[int, list[int], np.ndarray, list[int], np.ndarray]:
    """(n, sums, rounded means, sums of the centred entries, covariance) of the vectors ``x``."""
    spark = fit.sparkSession
    told = fit.mapInArrow(C.task(_sums), "at long, n long, high long, low long").groupBy("at")
    told = told.agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("at").collect()
    if not told:
        return 0, [], np.zeros(0, np.int64), [], np.zeros((0, 0))
    n, sums = told[0]["n"], [(r["high"] << 32) + r["low"] for r in told]
    centre = [round(Fraction(s, n)) for s in sums]
    sent = fit.mapInArrow(C.task(_products, centre=spark.sparkContext.broadcast(np.array(centre, np.int64))), "part int, power int, row int, sums binary")
    added = sent.repartitionById(PARTS, "part").mapInArrow(C.task(_add), "part int, power int, row int, sums binary")
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    whole = np.zeros((len(sums), len(sums)), object)
    for r in added.toLocalIterator():
        whole[r["row"]] += np.frombuffer(r["sums"], np.int64).astype(object) * (1 << (LIMB * r["power"]))
    centred = np.array(rest, object)
    exact = whole * n - centred[:, None] * centred[None, :]
    covariance = (exact / (n * n)).astype(np.float64)  # integers divide with one rounding
    return n, sums, np.array(centre, np.int64), rest, covariance


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit Householder vectors of a symmetric matrix: its reflections make it tridiagonal."""
    a, n, mirrors = a.copy(), len(a), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        scale = np.abs(v).max()
        if scale > 0:
            v /= scale
            v[0] += math.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        v = v / size if size > 0 else np.zeros(len(v))
        mirrors.append(v)
        low = a[k + 1 :, k + 1 :]
        p = low @ v
        w = 2 * (p - (v @ p) * v)
        low -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def count_below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues lie below each x: the negative pivots of the Sturm sequence."""
    q = diagonal[0] - x
    below = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:].tolist(), off.tolist(), strict=True):
        q = np.where(np.abs(q) < least, -least, q)
        q = d - x - e * e / q
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of a tridiagonal matrix, falling, by bisection down to neighbouring numbers."""
    n = len(diagonal)
    beside = np.r_[0, np.abs(off)] + np.r_[np.abs(off), 0]
    low, high = (diagonal - beside).min(), (diagonal + beside).max()
    wide = max(abs(low), abs(high), np.finfo(float).tiny)
    least = max(np.finfo(float).tiny, (np.finfo(float).eps * wide) ** 2)
    lows, highs = np.full(k, low - 1e-9 * wide), np.full(k, high + 1e-9 * wide)
    rank = n - 1 - np.arange(k)  # eigenvalues below the wanted one
    while True:
        middle = (lows + highs) / 2
        if ((middle <= lows) | (middle >= highs) | (highs - lows <= 1e-17 * wide)).all():
            return middle
        over = count_below(diagonal, off, middle, least) > rank
        highs, lows = np.where(over, middle, highs), np.where(over, lows, middle)


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) y = b for a tridiagonal T, by elimination with row exchanges; pivots of 0 become ``least``."""
    n = len(diagonal)
    d, e, e2 = (diagonal - shift).tolist(), off.tolist() + [0.0], [0.0] * n
    sub, y = off.tolist(), b.tolist()
    for i in range(n - 1):
        if abs(sub[i]) > abs(d[i]):  # the lower row leads
            ratio = d[i] / sub[i]
            d[i], e[i], e2[i], d[i + 1], e[i + 1] = sub[i], d[i + 1], e[i + 1], e[i] - ratio * d[i + 1], -ratio * e[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - ratio * y[i + 1]
        else:
            d[i] = d[i] or least
            ratio = sub[i] / d[i]
            d[i + 1] -= ratio * e[i]
            y[i + 1] -= ratio * y[i]
    for i in reversed(range(n)):
        rest = y[i] - (e[i] * y[i + 1] if i + 1 < n else 0) - (e2[i] * y[i + 2] if i + 2 < n else 0)
        y[i] = rest / (d[i] if abs(d[i]) > least else math.copysign(least, d[i]))
    return np.array(y)


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector (row) for each of the falling eigenvalues, by inverse iteration."""
    n, eps = len(diagonal), np.finfo(float).eps
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(float).tiny)
    rng, out, cluster, shift = np.random.default_rng(1), [], 0, None
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            cluster = i
        # equal shifts would give equal vectors, so those of a cluster are moved apart by a few roundings
        shift = value if i == cluster else min(value, shift - 4 * eps * norm)
        y = rng.normal(size=n)
        for _ in range(5):
            y = solve(diagonal, off, shift, y / np.linalg.norm(y), eps * norm)
            y /= np.abs(y).max()
            for _ in range(2):
                for earlier in out[cluster:]:
                    y -= (earlier @ y) * earlier
        out.append(y / np.linalg.norm(y))
    return np.array(out).reshape(len(values), n)


def components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) of a covariance and their unit eigenvectors (rows); vanishing ones left out."""
    n = len(covariance)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    diagonal, off, mirrors = tridiagonal(covariance)
    values = leading_values(diagonal, off, min(k, n))
    values = values[values > 8 * n * np.finfo(float).eps * np.trace(covariance)]
    vectors = leading_vectors(diagonal, off, values)
    for at, v in reversed(list(enumerate(mirrors, 1))):
        vectors[:, at:] -= 2 * np.outer(vectors[:, at:] @ v, v)
    turn = np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(1)[:, None], 1)) if len(vectors) else 1.0
    return values, vectors * turn


class Projection:
    """What tasks need to project vectors: the centre, the means' distance from it, the scaled components."""

    def __init__(self, n: int, centre: np.ndarray, rest: list[int], values: np.ndarray, vectors: np.ndarray):
        self.n, self.centre, self.rest = n, centre, rest
        self.shift = np.array([float(Fraction(r, n)) for r in rest])
        self.scaled = (vectors / np.sqrt(values)[:, None]).T

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(np.float64) - self.shift) @ self.scaled

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)**2 = (n (x - centre) - rest)**2 of each vector, exactly; None beyond a long."""
        z = x - self.centre
        far = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, self.rest), default=0)
        if far * far * z.shape[1] < 1 << 63:
            return ((self.n * z - np.array(self.rest, np.int64)) ** 2).sum(1).tolist()
        big = self.n * z.astype(object) - np.array(self.rest, object)
        return [s if s < 1 << 63 else None for s in (big * big).sum(1).tolist()]


def _moments(batches, projection):
    """Sum and products of this task's projections, each entry with its place."""
    total, sums = 0, 0
    for batch in batches:
        if batch.num_rows:
            w = projection.value.project(matrix(batch.column("x")))
            total, sums = total + w.T @ w, sums + w.sum(0)
    if not isinstance(total, int):
        k = len(sums)
        i, j = np.divmod(np.arange(k * (k + 1)), k)  # the last row holds the sums
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.r_[total.reshape(-1), sums])], names=["i", "j", "v"])


def identity_error(fit: DataFrame, n: int, projection) -> float:
    """Largest absolute entry of the covariance of the projected fit list minus the identity."""
    got = fit.mapInArrow(C.task(_moments, projection=projection), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    k = max((r["j"] for r in got), default=-1) + 1
    held = np.zeros((k + 1, k))
    for r in got:
        held[r["i"], r["j"]] = r["v"]
    mean = held[k] / n
    return float(np.abs(held[:k] / n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


_ROW = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _project(batches, projection, explained: list[float], error: float):
    p, k = projection.value, len(explained)
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            x = matrix(part.column("x"))
            m = part.num_rows
            deviation = pa.array(p.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            ids = part.column("id").take(pa.array(np.repeat(np.arange(m), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, p.n)), deviation]
            columns += [pa.array(p.project(x).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ROW.split(", ")])


def integers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the usable vectors as integers."""
    v = F.col(vector_col).cast("array<double>")
    d = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    fit = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    d = d.where((F.size("v") > 0) & fit)
    return d.select("id", F.transform("v", lambda c: F.floor(64 * c).cast("long") + 1000000).alias("x"))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    spark = C.prepare(df.sparkSession)
    x = integers(df, id_col, vector_col)
    fit = x.select("x").distinct()
    sizes = x.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    if size > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {size} dimensions; the driver's matrix allows {MOST_DIMENSIONS}")
    fit = C.stash(fit.where(F.size("x") == size))
    n, _, centre, rest, covariance = moments(fit)
    values, vectors = components(covariance, k)
    if not len(values):
        return spark.createDataFrame([], _ROW)
    projection = spark.sparkContext.broadcast(Projection(n, centre, rest, values, vectors))
    explained = (values / np.trace(covariance)).tolist()
    error = identity_error(fit, n, projection)
    return x.where(F.size("x") == size).mapInArrow(C.task(_project, projection=projection, explained=explained, error=error), _ROW)


def op12(spark, sf_dir: str) -> DataFrame:
    return whiten(C.table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
