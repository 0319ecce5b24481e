"""Judge filter, exact keep-best dedup, chat messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.text import strip_key
from sievecraft.operators.dedup import keep_best
from sievecraft.operators.ordering import scan_order
from sievecraft.operators.quality import passing_instructions
from sievecraft.operators.records import to_messages
from sievecraft.sources.corpus import read_jsonl
from sievecraft.sources.sinks import write_jsonl

MESSAGES_SCHEMA = "messages array<struct<role:string,content:string>>"


def best_rank() -> list:
    """Highest edge score first, then the shortest output."""
    return [F.col("edge_score").desc(), F.length("output").asc_nulls_last()]


def curate_instructions(df: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Passing rows, the best one per stripped input; ``seq`` kept for ordering."""
    passing = passing_instructions(df, *seq)
    return keep_best(passing, strip_key(F.col("input")), best_rank(), seq).drop("edge_score")


def export_instructions(df: DataFrame, seq: Sequence[str], out_dir: str, system_prompt: str) -> DataFrame:
    """Curated instructions as JSON lines in scan order, and their chat records.

    Writes ``table`` (Parquet, with the scan position) below ``out_dir`` and from it
    ``cleaned`` and ``messages``, both in scan order. Returns the chat records as written.
    """
    spark = df.sparkSession
    curate_instructions(df, seq).write.parquet(f"{out_dir}/table")
    cleaned = spark.read.parquet(f"{out_dir}/table")
    write_jsonl(scan_order(cleaned, seq).drop(*seq), f"{out_dir}/cleaned")
    # Sorted again from the table: the splits of the JSON files have no order.
    ordered = scan_order(cleaned, seq)
    write_jsonl(to_messages(ordered, system_prompt), f"{out_dir}/messages")
    return read_jsonl(spark, f"{out_dir}/messages", MESSAGES_SCHEMA, required=("messages",))
