"""Whitening of vectors on the leading components of their covariance, found by FEAST.

The covariance is added up in Spark. Counts of eigenvalues above a cut, read off the
inertia of the shifted matrix (law of Sylvester), split the top of the spectrum into
intervals of few eigenvalues each. For each interval one task solves the complex
systems of a Gauss quadrature around it, which projects a random block onto the
eigenvectors of the interval, and extracts them by Rayleigh-Ritz; this is repeated until
the residuals vanish. An interval that yields another number of eigenvalues than the
inertia counts is an error, never a result.

What the driver holds is the covariance, d x d numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.common import stored, table

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000  # entries become floor(SCALE * entry) + SHIFT
LARGEST = float(1 << 45)  # of SCALE * entry, so that sums stay exact
PER_INTERVAL, NODES, ROUNDS = 6, 8, 40
_CLEAR = 1e-9  # share of the spectrum around a cut that must be free of eigenvalues


@dataclass
class Whitening:
    """``axes`` has a unit eigenvector of the covariance in each row, by falling ``eigenvalues``."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(e) for e in self.eigenvalues / self.trace] if self.trace else []


# ---- eigenvalues in an interval ----------------------------------------------


def count_below(matrix: np.ndarray, cut: float) -> int:
    """Number of eigenvalues below ``cut``: negative pivots of L D L' with complete pivoting."""
    a = matrix - cut * np.eye(len(matrix))
    negative, ratio = 0, (1 + 17**0.5) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(np.triu(a, 1))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[p] == 0 and off[i, j] == 0:
            return negative
        pivot = [p] if diagonal[p] >= ratio * off[i, j] else [int(i), int(j)]
        block = a[np.ix_(pivot, pivot)]
        negative += int(block[0, 0] < 0) if len(pivot) == 1 else 1  # a pivot pair has one of either sign
        rest = np.delete(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return negative


def cut_spectrum(matrix: np.ndarray, wanted: int, most: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) of intervals that together hold the ``wanted`` largest, highest first.

    Eigenvalues within rounding of zero are none. An interval has at most ``most``
    eigenvalues unless they are too close to be told apart.
    """
    d = len(matrix)
    high = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9)
    floor = 4 * d * np.finfo(float).eps * high
    if not high:
        return []

    def above(cut: float) -> int:
        return d - count_below(matrix, cut)

    rank = above(floor)
    todo, out, found = [(floor, high, rank)], [], 0
    while todo and found < min(wanted, rank):
        lo, hi, n = todo.pop()
        if not n:
            continue
        clear = _CLEAR * high
        cuts = (lo + (hi - lo) * part for part in (0.5, 0.4, 0.6, 0.45, 0.55, 0.35, 0.65, 0.3, 0.7))
        split = None
        if n > most and hi - lo > 4 * clear:
            split = next(((c, k) for c in cuts if (k := above(c + clear)) == above(c - clear)), None)
        if split is None:
            out.append((*map(float, _tight(lo, hi, n, above, clear)), int(n)))
            found += n
            continue
        cut, k = split
        upper = k - sum(m for _, _, m in out)
        todo += [(lo, cut, n - upper), (cut, hi, upper)]
    return out


def _tight(lo: float, hi: float, n: int, above, clear: float) -> tuple[float, float]:
    """The interval without halves that are empty: others' eigenvalues then lie well outside."""
    while hi - lo > max(4 * clear, hi / 16):
        middle = (lo + hi) / 2
        k = above(middle)
        if k != above(middle + clear) or k != above(middle - clear):
            break
        over = k - above(hi)
        if over == n:
            lo = middle
        elif over == 0:
            hi = middle
        else:
            break
    return lo, hi


def feast(matrix: np.ndarray, low: float, high: float, wanted: int, nodes: int = NODES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high] and their unit eigenvectors as columns."""
    d = len(matrix)
    size = min(d, wanted + max(6, wanted // 2))
    block = np.random.default_rng(wanted).standard_normal((d, size))
    x, w = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(0.5j * np.pi * (1 - x)) * (high - low) / 2
    scale, best = np.abs(matrix).sum(axis=1).max(), None
    for _ in range(rounds):
        projected = np.zeros((d, block.shape[1]))
        for k in range(nodes):
            shifted = ((low + high) / 2 + turn[k]) * np.eye(d) - matrix
            projected += 0.5 * w[k] * (turn[k] * np.linalg.solve(shifted, block.astype(complex))).real
        u, s, _ = np.linalg.svd(projected, full_matrices=False)
        u = u[:, s > 1e-13 * s[0]]
        values, small = np.linalg.eigh(u.T @ matrix @ u)
        block = u @ small
        inside = (values > low) & (values <= high)
        if inside.sum() == wanted:
            pairs = values[inside], block[:, inside]
            residual = np.abs(matrix @ pairs[1] - pairs[1] * pairs[0]).max() / scale
            if best is not None and residual > 0.7 * best[0] and best[0] < 1e-13:
                break
            if best is None or residual < best[0]:
                best = residual, *pairs
    if best is None or best[0] > 1e-10:
        raise ArithmeticError(f"{wanted} eigenvalues in ({low}, {high}], not all found")
    return best[1], best[2]


def eigenpairs(spark, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues that are not zero, and unit eigenvectors in rows."""
    intervals = cut_spectrum(matrix, wanted)
    if not intervals:
        return np.empty(0), np.empty((0, len(matrix)))
    held = spark.sparkContext.broadcast(matrix)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                _, vectors = feast(held.value, part["low"], part["high"], part["n"])
                yield pa.RecordBatch.from_pydict({"vectors": pa.array(vectors.T.tolist(), pa.list_(pa.float64()))})

    rows = spark.createDataFrame(intervals, "low double, high double, n int").repartition(len(intervals), "low")
    found = rows.mapInArrow(work, "vectors array<double>").collect()
    if len(found) != sum(n for *_, n in intervals):
        raise ArithmeticError("the intervals yield another number of eigenvectors than the inertia counts")
    # once more over all intervals, so that their vectors are orthogonal to rounding
    q, _ = np.linalg.qr(np.array([r.vectors for r in found]).T)
    values, small = np.linalg.eigh(q.T @ matrix @ q)
    order = np.argsort(-values, kind="stable")[:wanted]
    axes = (q @ small[:, order]).T
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return values[order], axes * sign[:, None]


# ---- passes over the rows ------------------------------------------------------


def _matrix(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def grid_vector(vec: Column) -> Column:
    return F.transform(vec, lambda v: F.floor(v * SCALE) + SHIFT)


def usable(vec: Column) -> Column:
    """Not null or empty, all entries finite; those of more than 5e11 count as not finite."""
    fits = F.forall(vec, lambda v: F.coalesce(F.abs(v * SCALE) < LARGEST, F.lit(False)))
    return F.coalesce((F.size(vec) > 0) & fits, F.lit(False))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, the whole part taken off first."""
    whole = sums // n
    return (x - whole).astype(np.float64) - (sums - n * whole) / n


def _summed(parts: DataFrame) -> np.ndarray:
    """Rows i of a matrix, each the sum of the vectors ``v`` under i; every row has its own reducer key."""
    rows = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()
    return np.array([r.v for r in sorted(rows, key=lambda r: r.i)])


def products(fit: DataFrame, d: int, n: int, sums: np.ndarray, axes: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the fit list, or of its projections on ``axes``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, offset = 0.0, 0.0
        for batch in batches:
            y = _centred(_matrix(batch, "x", d), n, sums)
            y = y if axes is None else y @ axes.T
            total, offset = total + y.T @ y, offset + y.sum(axis=0)
        if not np.isscalar(total):
            rows = [*total, offset]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(rows)), pa.int32()), "v": pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))})

    *square, offset = _summed(fit.mapInArrow(work, "i int, v array<double>"))
    mean = offset / n  # rounding of S / n
    out = np.array(square) / n - np.outer(mean, mean)
    return (out + out.T) / 2


def fit_whitening(df: DataFrame, vec: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of the different grid vectors of ``df``; None if no row is usable.

    Usable are vectors of the most frequent length (of equals the largest) that pass
    ``usable``. There are fewer components than asked for if fewer eigenvalues are
    above zero: none at all for a single vector.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(vec).cast("array<double>").alias("vec")).where(usable(F.col("vec")))
    lengths = vectors.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    d = lengths.d
    fit = stored(vectors.where(F.size("vec") == d).select(grid_vector(F.col("vec")).alias("x")).distinct(), "fit-list")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "x", d)
            if len(x):
                sums = pa.array([*x.sum(axis=0).tolist(), len(x)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), sums], ["i", "s"])

    added = fit.mapInArrow(add, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    *sums, n = (int(r.s) for r in sorted(added, key=lambda r: r.i))
    held = np.array(sums, np.int64 if max(map(abs, sums)) < 1 << 62 else object)
    covariance = products(fit, d, n, held)
    values, axes = eigenpairs(spark, covariance, components)
    error = 0.0
    if len(values):
        white = products(fit, d, n, held, axes / np.sqrt(values)[:, None])
        error = float(np.abs(white - np.eye(len(values))).max())
    return Whitening(n, sums, values, axes, float(np.trace(covariance)), error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a 64-bit number."""
    exact = np.array(sums, object)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array(exact - n * whole.astype(object), np.int64)
    size = np.abs(x - whole).max(initial=0) * float(n) + float(n)
    if size * size * x.shape[1] < 2.0**62:
        t = n * (x - whole) - rest
        return (t * t).sum(axis=1).tolist()
    t = n * (x - whole).astype(object) - rest.astype(object)
    return [int(s) if s < 1 << 63 else None for s in (t * t).sum(axis=1)]


def whiten(df: DataFrame, model: Whitening, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``vec_id``, ``deviation``, ``whitened`` (one number a component) of every usable row of the fitted length."""
    d, n, sums = len(model.sums), model.n, model.sums
    axes = model.axes / np.sqrt(model.eigenvalues)[:, None]
    held = np.array(sums, np.int64 if max(map(abs, sums)) < 1 << 62 else object)
    rows = df.select(F.col(vec_id).alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(usable(F.col("vec")) & (F.size("vec") == d))
    rows = rows.select("id", grid_vector(F.col("vec")).alias("x"))
    id_type = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "x", d)
            white = _centred(x, n, held) @ axes.T
            lists = pa.array(white.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(deviations(x, n, sums), pa.int64()), lists], ["id", "deviation", "whitened"])

    out = rows.mapInArrow(work, f"id {id_type}, deviation long, whitened array<double>")
    return out.select(F.col("id").alias(vec_id), "deviation", "whitened")


def whitened_rows(df: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``df`` and component, numbered from 1 by falling eigenvalue.

    Rows whose vector is null, empty, of another length than most, or holds null or
    non-finite entries have no row, nor has anything if all usable vectors are equal:
    no direction varies then. Rows without an id, repeated rows and ids give their own rows. Other
    columns are not read.
    """
    id_type = df.schema[vec_id].dataType.simpleString()
    model = fit_whitening(df, vec, components)
    if model is None or not len(model.eigenvalues):
        columns = f"`{vec_id}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], columns)
    long = whiten(df, model, vec_id, vec).select(vec_id, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        vec_id,
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, model.explained)), F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def op12_feast_whitening(spark, sf_dir: str) -> DataFrame:
    """Every usable vector on each of the first 16 components."""
    return whitened_rows(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_feast_whitening": op12_feast_whitening}
ORACLE: dict[str, str] = {}
