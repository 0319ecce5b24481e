"""Verified filter, n-gram-set dedup, chat records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sievecraft.functions.text import ngram_fingerprint
from sievecraft.operators.dedup import keep_first
from sievecraft.operators.ordering import sort_by_id
from sievecraft.operators.profile import length_profile, token_totals
from sievecraft.operators.quality import FUNNEL, MAX_COT_TOKENS, fill_texts, funnel_counts, keep_verified, with_reject_reason
from sievecraft.operators.records import to_chat_records
from sievecraft.sources.sinks import write_json_array, write_jsonl


def unique_verified(df: DataFrame, seq: Sequence[str], max_tokens: int = MAX_COT_TOKENS, n: int = 5) -> DataFrame:
    """Verified rows within the token budget, one per question fingerprint."""
    return keep_first(keep_verified(df, max_tokens), ngram_fingerprint(F.col("question"), n), seq)


def curate_reasoning(
    df: DataFrame, seq: Sequence[str], max_tokens: int = MAX_COT_TOKENS, n: int = 5
) -> DataFrame:
    """Chat records of the unique verified rows, ``seq`` kept for ordering."""
    return to_chat_records(unique_verified(df, seq, max_tokens, n), *seq)


def reasoning_measures() -> dict:
    """The four measures the length profile of chat records covers."""
    return {
        name: F.col("metadata")[name]
        for name in ("question_length", "response_length", "code_length", "cot_tokens")
    }


def profile_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Length profile and token totals of chat records."""
    meta = F.col("metadata")
    return (
        length_profile(records, reasoning_measures()),
        token_totals(records, meta["question_length"], meta["response_length"]),
    )


def export_reasoning(
    df: DataFrame, seq: Sequence[str], out_dir: str, max_tokens: int = MAX_COT_TOKENS, n: int = 5
) -> DataFrame:
    """Curates once into ``records``, and derives both exports and the profile from that table.

    Writes ``records`` (Parquet), ``jsonl`` and ``json`` below ``out_dir``, all but
    the first in id order. Returns the written records; see ``profile_records``.
    """
    spark = df.sparkSession
    curate_reasoning(df, seq, max_tokens, n).write.parquet(f"{out_dir}/records")
    records = spark.read.parquet(f"{out_dir}/records")
    write_jsonl(sort_by_id(records, "id", seq).drop(*seq), f"{out_dir}/jsonl")
    write_json_array(records, f"{out_dir}/json", ["id", *seq], drop=seq)
    return records


@dataclass(frozen=True)
class Counted:
    """What ``curate_counted`` wrote and what it counted on the way."""

    records: DataFrame
    funnel: DataFrame
    files: DataFrame


def curate_counted(
    df: DataFrame, seq: Sequence[str], out_dir: str, file_col: str = "file_name", max_tokens: int = MAX_COT_TOKENS, n: int = 5
) -> Counted:
    """Curates a corpus of many files with its counters, in one scan of the corpus.

    The pass that writes the rows that pass the filter (``kept`` below ``out_dir``)
    counts what it rejects; nothing is read again for the funnel. The files' kept rows
    are counted on that table, and all their rows without reading a column. Dedup works
    on ``kept`` too and writes the chat records (``records``).
    """
    spark, funnel = df.sparkSession, Observation()
    judged = with_reject_reason(df, max_tokens).observe(funnel, *funnel_counts(F.col("reason")))
    fill_texts(judged.where("reason IS NULL").drop("reason")).write.parquet(f"{out_dir}/kept")
    kept = spark.read.parquet(f"{out_dir}/kept")
    unique = keep_first(kept, ngram_fingerprint(F.col("question"), n), seq)
    to_chat_records(unique, *seq).write.parquet(f"{out_dir}/records")
    counts = funnel.get
    totals = df.groupBy(file_col).agg(F.count(F.lit(1)).alias("total"))
    passed = kept.groupBy(file_col).agg(F.count(F.lit(1)).alias("kept"))
    files = totals.join(passed, file_col, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return Counted(
        spark.read.parquet(f"{out_dir}/records"),
        spark.range(1).select(*[F.lit(counts[name]).cast("long").alias(name) for name in FUNNEL]),
        files.select(file_col, "kept", "total", F.round(F.try_divide(F.col("kept") * 100.0, "total"), 1).alias("kept_percent")),
    )
