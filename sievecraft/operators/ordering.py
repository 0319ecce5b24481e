"""Row order, sampling and numbering that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.functions.ordering import seeded_digest, seeded_uniform
from sievecraft.session import shared_path


def sort_by_id(df: DataFrame, id_col: str, seq: Sequence[str]) -> DataFrame:
    """Global order by id, equal ids in scan order."""
    return df.orderBy(id_col, *seq)


def scan_order(df: DataFrame, seq: Sequence[str]) -> DataFrame:
    return df.orderBy(*seq)


def sample_order(df: DataFrame, key: str, seed: int, shuffled: bool = True) -> DataFrame:
    """Rows in a seeded random order, or by ``key`` when shuffling is off."""
    return df.orderBy(seeded_digest(F.col(key), seed), key) if shuffled else df.orderBy(key)


def sample_cap(df: DataFrame, seq: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in scan order.

    Only the position columns are ranked, over ranges of them, to find the last
    position that is in; the rows themselves are filtered where they lie.
    """
    if n < 1:
        return df.limit(0)
    pos = F.struct(*seq)
    ranked = number_rows(df.select(*seq), seq, "_rank")
    cut = ranked.where(F.col("_rank") == n - 1).agg(F.max(pos)).scalar()
    return df.where(F.coalesce(pos <= cut, F.lit(True)))  # no cut: there are fewer rows


def holdout_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Adds ``split``: "validation" for about ``fraction`` of the keys, else "train"."""
    held = seeded_uniform(F.col(key), seed) < fraction
    return df.withColumn("split", F.when(held, "validation").otherwise("train"))


def number_rows(df: DataFrame, seq: Sequence[str] | str, out: str = "row_number", by: Sequence[str] = ()) -> DataFrame:
    """Adds the 0-based rank of each row by the columns ``seq``, within groups of ``by``.

    Any columns that can be sorted will do, such as (file, row). Equal rows get
    different ranks in an arbitrary order. Columns of ``by`` must not be null.

    No window holds a whole group, let alone all rows: rows are dealt to ranges of
    (by, seq) and written once, ranked inside their range, and the rows of the same
    group in the ranges before are added. Only the first group of a range can begin
    before it, so these offsets are no more than the ranges.
    """
    seq = [seq] if isinstance(seq, str) else list(seq)
    session, by = df.sparkSession, list(by)
    path = shared_path(session, "ranges")
    df.repartitionByRange(*by, *seq).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = session.read.parquet(path)
    counts = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_range", F.sum("_n").over(before).alias("_before")).where("_before > 0")
    local = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*seq)) - 1
    ranked = dealt.withColumn("_local", local).join(F.broadcast(offsets), [*by, "_range"], "left")
    rank = F.col("_local") + F.coalesce("_before", F.lit(0))
    return ranked.select(*df.columns, rank.cast("long").alias(out))
