"""Seeded numbers that depend on the row alone, not on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievecraft.functions.text import let

_HASH_RANGE = float(1 << 32)


def seeded_digest(key: Column, seed: int | str) -> Column:
    """md5 of seed and key: the same on every run, engine and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _unit(hex8: Column) -> Column:
    return (F.conv(hex8, 16, 10).cast("long") + 0.5) / F.lit(_HASH_RANGE)


def seeded_uniform(key: Column, seed: int | str) -> Column:
    """A number in (0, 1) fixed by key and seed."""
    return _unit(F.substring(seeded_digest(key, seed), 1, 8))


def seeded_normal_vector(key: Column, dim: int, seed: int | str) -> Column:
    """``dim`` standard normal numbers fixed by key and seed (Box-Muller)."""

    def draw(i: Column) -> Column:
        digest = seeded_digest(F.concat(key.cast("string"), F.lit("#"), i.cast("string")), seed)
        return let(
            digest,
            lambda d: F.sqrt(-2 * F.log(_unit(F.substring(d, 1, 8))))
            * F.cos(2 * math.pi * _unit(F.substring(d, 9, 8))),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), draw)
