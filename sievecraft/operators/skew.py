"""Equi-join against a table with unique keys when the other side has hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the rows. There are at most
# 1 / share such keys whatever the data, so their list may be broadcast.
HOT_SHARE = 1 / 256
SALTS = 64


def fits_broadcast(df: DataFrame) -> bool:
    """The planner's size estimate of ``df`` is within its broadcast limit."""
    session = df.sparkSession._jsparkSession
    limit = session.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """The keys that hold more than ``share`` of the rows: fewer than 1 / share."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where(F.col("_n") > total * share).select(key)


def join_unique(
    left: DataFrame,
    right: DataFrame,
    key: str,
    row_id: Sequence[str],
    how: str = "left",
    share: float = HOT_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """``left`` joined with ``right``, which holds each ``key`` once.

    A ``right`` within the broadcast limit is broadcast by the planner, where hot
    keys do no harm. Beyond it both sides are shuffled and salted: rows of hot keys are spread over ``salts`` partitions and only the few
    matching rows of ``right`` are repeated. ``row_id`` identifies a left row; the
    salt is a hash of it, so a recomputed task salts its rows as before.
    """
    if fits_broadcast(right):
        return left.join(right, key, how)
    hot = F.broadcast(hot_keys(left, key, share).withColumn("_hot", F.lit(True)))
    some_salt = F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int")
    spread = F.col("_hot").isNotNull() | F.col(key).isNull()  # null keys match nothing, wherever they go
    salted_left = (
        left.join(hot, key, "left").withColumn("_salt", F.when(spread, some_salt).otherwise(F.lit(0))).drop("_hot")
    )
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    copies = F.when(F.col("_hot").isNotNull(), all_salts).otherwise(F.array(F.lit(0)))
    salted_right = right.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
