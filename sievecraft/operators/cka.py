"""Linear CKA with the unbiased HSIC estimator, in covariance form.

With centred x and y, a = |x|^2, b = |y|^2 per row, S a sum over rows and n rows:

    HSIC = (||X'Y||^2 - S(ab) + S(a) S(b) / ((n-1)(n-2)) - 2 S(ab) / (n-2)) / (n (n-3))

so the state is d1 x d2 numbers per group, never n x n.

A group of bounded bytes is gathered whole, centred and multiplied in one call, and
leaves as a few numbers: its matrices are never shuffled. Larger groups are cut into
such pieces by a hash of the row; only the matrices of these pieces are added up, each
matrix row under its own reducer key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.vectors import CKA_EPS, doubles

MIN_ROWS = 4  # the estimator divides by n - 3
PIECE_BYTES = 32 << 20  # of the vectors that a task holds at once
_SUMS = ("n", "sa", "sb", "sab", "saa", "sbb")


def _vectors(rows: pa.Table, name: str) -> np.ndarray:
    """A table column of equally long lists as a matrix."""
    lists = rows.column(name).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64, copy=False)


def _row_sums(x: np.ndarray, y: np.ndarray) -> list[float]:
    a, b = (x * x).sum(axis=1), (y * y).sum(axis=1)
    return [float(v) for v in (len(x), a.sum(), b.sum(), (a * b).sum(), (a * a).sum(), (b * b).sum())]


def _frobenius(u: np.ndarray, v: np.ndarray) -> float:
    """||U'V||^2, over pairs of rows where rows are fewer than columns."""
    if len(u) < min(u.shape[1], v.shape[1]):
        return float(((u @ u.T) * (v @ v.T)).sum())
    return float(((u.T @ v) ** 2).sum())


def _whole_group(rows: pa.Table) -> pa.Table:
    """The sums of a group that fits."""
    x, y = _vectors(rows, "x"), _vectors(rows, "y")
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    values = dict(zip(_SUMS, _row_sums(x, y))) | {"xy": _frobenius(x, y), "xx": _frobenius(x, x), "yy": _frobenius(y, y)}
    return pa.table({"g": rows.column("g").slice(0, 1), **{c: pa.array([v], pa.float64()) for c, v in values.items()}})


def _piece(rows: pa.Table) -> pa.Table:
    """The matrices of a piece of a group, row by row; the mean of the group comes with its rows."""
    first = rows.slice(0, 1)
    x, y = _vectors(rows, "x") - _vectors(first, "mx"), _vectors(rows, "y") - _vectors(first, "my")
    parts = {"xy": x.T @ y, "xx": x.T @ x, "yy": y.T @ y, "s": [_row_sums(x, y)]}
    stat, i, v = zip(*[(stat, i, list(row)) for stat, matrix in parts.items() for i, row in enumerate(matrix)])
    g = pa.array([rows.column("g")[0].as_py()] * len(i), pa.string())
    return pa.table({"g": g, "stat": pa.array(stat), "i": pa.array(i, pa.int32()), "v": pa.array(v, pa.list_(pa.float64()))})


def _large_groups(rows: DataFrame, large: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """The sums of the groups in ``large`` (g, pieces), added up over their pieces."""

    def mean(c: str) -> Column:
        return vector_to_array(Summarizer.mean(array_to_vector(c)))

    means = rows.groupBy("g").agg(mean("x").alias("mx"), mean("y").alias("my"))
    pieces = means.join(large, "g").select("g", "mx", "my", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    some = F.pmod(F.xxhash64(*row_id), F.col("pieces")).cast("int")
    dealt = rows.join(large, "g").select("g", "x", "y", some.alias("piece")).join(pieces, ["g", "piece"])
    partial = dealt.groupBy("g", "piece").applyInArrow(_piece, "g string, stat string, i int, v array<double>")
    summed = partial.groupBy("g", "stat", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda acc, v: acc + v * v)
    stats = summed.groupBy("g").agg(
        *[F.sum(F.when(F.col("stat") == name, squares)).alias(name) for name in ("xy", "xx", "yy")],
        F.first(F.when(F.col("stat") == "s", F.col("v")), ignorenulls=True).alias("s"),
    )
    # the summarizer rebuilds sums from means, a hair off the integer
    sums = [(F.round(F.col("s")[k]) if c == "n" else F.col("s")[k]).alias(c) for k, c in enumerate(_SUMS)]
    return stats.select("g", *sums, "xy", "xx", "yy")


def _hsic(frobenius: Column, n: Column, sa: Column, sb: Column, sab: Column) -> Column:
    return (frobenius - sab + sa * sb / ((n - 1) * (n - 2)) - 2 * sab / (n - 2)) / (n * (n - 3))


def linear_cka(
    df: DataFrame, x: Column, y: Column, row_id: Sequence[str], by: Column | None = None, eps: float = CKA_EPS, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """(group, n, cka, distance): alignment of two vectors over the rows of each group.

    The vectors may differ in length. Groups of fewer than four rows have no value. A
    group of more than ``piece_bytes`` is worked on in pieces; rows of a null group are
    a group.
    """
    group = F.lit("all") if by is None else by.cast("string")
    rows = df.select(*row_id, group.alias("g"), doubles(x).alias("x"), doubles(y).alias("y"))
    width = rows.select(F.size("x") + F.size("y")).first()
    limit = max(MIN_ROWS, piece_bytes // (8 * max(1, width[0] if width else 1)))
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = counts.where(F.col("n") > limit).select("g", F.ceil(F.col("n") / limit).cast("int").alias("pieces"))
    # Known before the plan is made, so that a corpus of small groups has no second branch.
    some_large = not large.isEmpty()
    keyed = rows.select("g", "x", "y")
    small = keyed.join(large.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")), "left_anti") if some_large else keyed
    columns = ", ".join(f"{c} double" for c in (*_SUMS, "xy", "xx", "yy"))
    stats = small.groupBy("g").applyInArrow(_whole_group, f"g string, {columns}")
    if some_large:
        # a null group that is large joins under a name that no other group has
        named = F.coalesce(F.concat(F.lit("="), "g"), F.lit("null"))
        of_large = rows.withColumn("g", named)
        found = _large_groups(of_large, large.withColumn("g", named), row_id)
        stats = stats.unionByName(found.withColumn("g", F.when(F.col("g") != "null", F.substr("g", F.lit(2)))))
    n = F.when(F.col("n") >= MIN_ROWS, F.col("n"))  # null below: no division by zero
    hxy = _hsic(F.col("xy"), n, F.col("sa"), F.col("sb"), F.col("sab"))
    hxx = _hsic(F.col("xx"), n, F.col("sa"), F.col("sa"), F.col("saa"))
    hyy = _hsic(F.col("yy"), n, F.col("sb"), F.col("sb"), F.col("sbb"))
    cka = hxy / (F.sqrt(F.greatest(hxx * hyy, F.lit(eps))) + eps)
    value = F.when(n.isNotNull(), F.least(F.greatest(cka, F.lit(0.0)), F.lit(1.0)))
    return stats.select(
        F.col("g").alias("group"),
        F.col("n").cast("long").alias("n"),
        value.alias("cka"),
        (1 - value).alias("distance"),
    )
