"""Vector expressions on array columns, accumulated in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievecraft.functions.text import let

# Guards against division by zero.
NORM_EPS = 1e-12
COSINE_EPS = 1e-8
CKA_EPS = 1e-8
POOL_EPS = 1e-9


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def l2_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    return let(
        doubles(v),
        lambda d: let(F.greatest(norm(d), F.lit(NORM_EPS)), lambda n: F.transform(d, lambda x: x / n)),
    )


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def cosine_distance(a: Column, b: Column) -> Column:
    eps = F.lit(COSINE_EPS)
    return 1 - dot(a, b) / (F.greatest(norm(a), eps) * F.greatest(norm(b), eps))


def mean_squared_difference(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))) / F.size(a)


def interpolate(z1: Column, z0: Column, t: Column) -> Column:
    """Point at ``t`` on the way from ``z0`` to ``z1``."""
    return F.zip_with(doubles(z1), doubles(z0), lambda x, y: t * x + (1 - t) * y)


def velocity(z1: Column, z0: Column) -> Column:
    return F.zip_with(doubles(z1), doubles(z0), lambda x, y: x - y)


# Names of the measures between a predicted and a wanted vector. "flow_matching"
# compares velocities, see ``operators.embed.interpolation_pairs``; "cka" compares all
# vectors of a group at once and is no function of a row.
ROW_METRICS = {
    "flow_matching": mean_squared_difference,
    "cosine": cosine_distance,
    "mse": mean_squared_difference,
}
GROUP_METRIC = "cka"


def vector_metric(name: str) -> Callable[[Column, Column], Column]:
    """The measure of that name between two vectors of a row."""
    if name not in ROW_METRICS:
        known = ", ".join([*ROW_METRICS, GROUP_METRIC])
        hint = " compares groups: use operators.alignment.metric_loss" if name == GROUP_METRIC else f" is not one of {known}"
        raise ValueError(f"metric {name!r}{hint}")
    return ROW_METRICS[name]
