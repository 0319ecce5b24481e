"""Loss between predicted and wanted vectors by the name of a metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.vectors import GROUP_METRIC, vector_metric
from sievecraft.operators.cka import linear_cka


def metric_loss(
    df: DataFrame, metric: str, predicted: Column, wanted: Column, row_id: Sequence[str], by: Column | None = None, weight: Column | None = None
) -> DataFrame:
    """(group, n, loss): one loss per group under ``metric``.

    A metric of rows is averaged over the rows, with ``weight`` if given; weights that
    sum to less than 1 count as 1. "cka" takes the vectors of a group together, knows no
    weights, and has no loss for fewer than four rows. An unknown name raises.
    """
    if metric == GROUP_METRIC:
        return linear_cka(df, predicted, wanted, row_id, by).select("group", "n", F.col("distance").alias("loss"))
    group = F.lit("all") if by is None else by.cast("string")
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(group.alias("group"), vector_metric(metric)(predicted, wanted).alias("_loss"), w.alias("_weight"))
    mean = F.sum(F.col("_loss") * F.col("_weight")) / F.greatest(F.sum("_weight"), F.lit(1.0))
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), mean.alias("loss"))
