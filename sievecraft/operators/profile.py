"""Length profile and token totals of curated records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.functions.text import CHARS_PER_TOKEN


def value_histogram(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """(measure, value, n): how often each value of each measure occurs."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("long").alias("value")) for m, c in measures.items()])
    return df.select(F.inline(pairs)).groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n"))


def length_profile(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """Minimum, upper median and maximum of each measure.

    The median is the element at position n // 2 of the sorted values. It is
    read off a histogram, so what is ordered in one task per measure is the set
    of distinct lengths, not the rows.
    """
    hist = value_histogram(df, measures)
    by_measure = Window.partitionBy("measure")
    upto = by_measure.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = hist.select(
        "measure",
        "value",
        F.sum("n").over(upto).alias("upto"),
        F.sum("n").over(by_measure).alias("total"),
    )
    in_upper_half = F.col("upto") > F.expr("total div 2")
    return ranked.groupBy("measure").agg(
        F.min("value").alias("min_value"),
        F.min(F.when(in_upper_half, F.col("value"))).alias("p50_value"),
        F.max("value").alias("max_value"),
        F.max("total").alias("entries"),
    )


def token_totals(df: DataFrame, question_length: Column, response_length: Column) -> DataFrame:
    """Estimated tokens in all and per entry; the average of nothing is null."""
    chars = F.coalesce(F.sum((question_length + response_length).cast("long")), F.lit(0))
    sums = df.agg(F.count(F.lit(1)).alias("entries"), chars.alias("total_chars"))
    total = F.expr(f"total_chars div {CHARS_PER_TOKEN}")
    return sums.select(
        "entries",
        total.alias("total_tokens"),
        F.when(F.col("entries") > 0, F.expr(f"(total_chars div {CHARS_PER_TOKEN}) div entries")).alias("mean_tokens"),
    )
