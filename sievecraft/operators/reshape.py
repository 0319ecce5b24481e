"""Batches: preference pairs, target/reference rows, assets, padding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.functions.labels import IGNORE_INDEX
from sievecraft.operators.ordering import number_rows

# Fixed values.
TOKEN_FIELDS = ("input_ids", "attention_mask", "labels")
ASSET_FIELDS = ("images", "videos", "audios")
PAD_VALUES = {"input_ids": 0, "attention_mask": 0, "labels": IGNORE_INDEX}
PAD_MULTIPLE = 8


def unpivot_pairs(df: DataFrame, *keep: str, assets: Sequence[str] = ASSET_FIELDS) -> DataFrame:
    """Two rows per pair: ``side`` 0 with the chosen arrays, 1 with the rejected ones.

    Ordering a batch by (side, pair) puts all chosen rows before all rejected ones.
    """

    def side(number: int, prefix: str):
        fields = [F.col(f"{prefix}_{f}").alias(f) for f in TOKEN_FIELDS]
        return F.struct(F.lit(number).alias("side"), *fields)

    sides = F.inline(F.array(side(0, "chosen"), side(1, "rejected")))
    return df.select(*keep, *[a for a in assets if a in df.columns], sides)


def split_target_reference(df: DataFrame, *keep: str, assets: Sequence[str] = ASSET_FIELDS) -> DataFrame:
    """``target`` and ``reference`` structs of one row, sharing its assets, and its tag."""
    shared = [a for a in assets if a in df.columns]
    target = F.struct(*TOKEN_FIELDS, *shared)
    reference = F.struct(*[F.col(f"kl_{f}").alias(f) for f in TOKEN_FIELDS], *shared)
    return df.select(*keep, target.alias("target"), reference.alias("reference"), "kto_tags")


def assign_batches(df: DataFrame, seq: Sequence[str] | str, batch_size: int) -> DataFrame:
    """Adds ``batch``: consecutive rows in the order of ``seq``, one column or several, ``batch_size`` at a time."""
    numbered = number_rows(df, seq, "_row")
    return numbered.withColumn("batch", F.floor(F.col("_row") / batch_size)).drop("_row")


def flatten_assets(df: DataFrame, seq: str, assets: Sequence[str] = ASSET_FIELDS) -> DataFrame:
    """Per batch: each asset list laid end to end in row order, and the count of each row."""
    filled = {a: F.coalesce(F.col(a), F.array().cast("array<string>")) for a in assets}
    rows = F.sort_array(F.collect_list(F.struct(seq, *assets)))
    grouped = df.withColumns(filled).groupBy("batch").agg(rows.alias("_rows"))

    def lists(asset: str):
        return F.transform("_rows", lambda r: r[asset])

    flat = [F.flatten(lists(a)).alias(a) for a in assets]
    counts = [F.transform(lists(a), lambda v: F.size(v)).alias(f"{a}_counts") for a in assets]
    return grouped.select("batch", *flat, *counts)


def pad_batches(
    df: DataFrame,
    pads: Mapping[str, int] = PAD_VALUES,
    multiple: int = PAD_MULTIPLE,
    left: bool = False,
) -> DataFrame:
    """Token arrays of each batch, brought to one length: a multiple of ``multiple``."""
    longest = F.max(F.greatest(*[F.size(c) for c in pads], F.lit(0))).over(Window.partitionBy("batch"))
    target = (F.ceil(longest / multiple) * multiple).cast("int")
    sized = df.withColumn("padded_length", target)

    def pad(name: str, value: int):
        fill = F.array_repeat(F.lit(value), F.col("padded_length") - F.size(name))
        return F.concat(fill, F.col(name)) if left else F.concat(F.col(name), fill)

    return sized.withColumns({name: pad(name, value) for name, value in pads.items()})
