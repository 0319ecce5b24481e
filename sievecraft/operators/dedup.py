"""Exact and n-gram-set deduplication.

Only the key, the ranking columns and the row identity take part in choosing the
winners. Each map task reduces its rows to one per key before the shuffle, so a
key shared by a third of the corpus costs one narrow row per task. The payload
then meets the winners on the unique row identity, where no value can be hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEY = "_dedup_key"


def winners_by_rank(df: DataFrame, key: Column, rank: Sequence[Column], seq: Sequence[str]) -> DataFrame:
    """Identity of the first row of each key under ``rank`` and then ``seq``."""
    order = [*rank, *[F.col(s).asc() for s in seq]]
    spec = Window.partitionBy(_KEY).orderBy(*order)
    ranked = df.withColumn(_KEY, key).withColumn("_rank", F.row_number().over(spec))
    return ranked.where("_rank = 1").select(*seq)


def first_by_key(df: DataFrame, key: Column, seq: Sequence[str]) -> DataFrame:
    """Identity of the earliest row of each key."""
    if len(seq) > 1:
        return winners_by_rank(df, key, [], seq)
    # One orderable column: a hash aggregate with map-side combine.
    return df.select(key.alias(_KEY), *seq).groupBy(_KEY).agg(F.min(seq[0]).alias(seq[0])).select(*seq)


def keep_best(df: DataFrame, key: Column, rank: Sequence[Column], seq: Sequence[str]) -> DataFrame:
    """One row per key: the best under ``rank``, the earliest among equals.

    ``seq`` names the columns that identify a row and give the scan order.
    """
    return df.join(winners_by_rank(df, key, rank, seq), list(seq), "left_semi")


def keep_first(df: DataFrame, key: Column, seq: Sequence[str]) -> DataFrame:
    """One row per key: the earliest in scan order."""
    return df.join(first_by_key(df, key, seq), list(seq), "left_semi")


def dedup_report(df: DataFrame, key: Column) -> DataFrame:
    """Rows before, distinct keys, rows a dedup on ``key`` removes."""
    counts = df.select(key.alias(_KEY)).groupBy(_KEY).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("before"),
        F.count(F.lit(1)).alias("unique"),
    ).withColumn("removed", F.col("before") - F.col("unique"))
