"""Row filters with their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.judgement import MIN_SCORES, passing_score
from sievecraft.functions.text import est_tokens, text_or_empty

# Fixed values.
MAX_COT_TOKENS = 16000
INSTRUCTION_COLUMNS = ("id", "input", "output", "domain", "generation_algorithm")
FUNNEL = ("total_rows", "not_verified", "not_passed", "cot_too_long", "passed_filter")
TEXT_COLUMNS = ("question", "response", "code", "starter_code")


def score_instructions(df: DataFrame, mins: dict[str, float] = MIN_SCORES) -> DataFrame:
    """Adds ``passed`` and ``edge_score`` (0 where the row does not pass)."""
    score = passing_score(F.col("llm_judgement"), F.col("tests_execution_status"), mins)
    return (
        df.withColumn("_score", score)
        .withColumn("passed", F.col("_score").isNotNull())
        .withColumn("edge_score", F.coalesce("_score", F.lit(0.0)))
        .drop("_score")
    )


def passing_instructions(df: DataFrame, *keep: str, mins: dict[str, float] = MIN_SCORES) -> DataFrame:
    """Passing rows that have an input, with the output columns and ``edge_score``."""
    score = passing_score(F.col("llm_judgement"), F.col("tests_execution_status"), mins)
    scored = df.withColumn("edge_score", score).where("edge_score IS NOT NULL AND input IS NOT NULL")
    return scored.select(*INSTRUCTION_COLUMNS, "edge_score", *keep)


def fill_texts(df: DataFrame) -> DataFrame:
    """Null texts become empty ones; an absent starter column becomes empty too."""
    missing = {} if "starter_code" in df.columns else {"starter_code": F.lit("")}
    filled = {c: text_or_empty(F.col(c)) for c in TEXT_COLUMNS if c in df.columns}
    return df.withColumns({**missing, **filled})


def with_reject_reason(df: DataFrame, max_tokens: int = MAX_COT_TOKENS) -> DataFrame:
    """Adds ``reason``: the first failing test, null where the row is kept."""
    tokens = est_tokens(text_or_empty(F.col("response")))
    return df.withColumn(
        "reason",
        F.when(~F.coalesce("verified", F.lit(False)), "not_verified")
        .when(~F.coalesce("is_passed", F.lit(False)), "not_passed")
        .when(tokens > max_tokens, "cot_too_long"),
    )


def keep_verified(df: DataFrame, max_tokens: int = MAX_COT_TOKENS) -> DataFrame:
    """The rows without a reject reason.

    Written as plain conjuncts so that both flags reach the Parquet reader.
    """
    flags = (F.col("verified") == True) & (F.col("is_passed") == True)  # noqa: E712
    kept = df.where(flags & (est_tokens(text_or_empty(F.col("response"))) <= max_tokens))
    return fill_texts(kept)


def funnel_counts(reason: Column) -> list[Column]:
    """The counters of the filter: rows read, rows per reject reason, rows kept."""
    tests = {name: reason == name for name in FUNNEL[1:-1]}
    return [
        F.count(F.lit(1)).alias(FUNNEL[0]),
        *[F.count_if(test).alias(name) for name, test in tests.items()],
        F.count_if(reason.isNull()).alias(FUNNEL[-1]),
    ]


def filter_funnel(df: DataFrame, max_tokens: int = MAX_COT_TOKENS) -> DataFrame:
    """One row of ``funnel_counts``; a single pass."""
    return with_reject_reason(df, max_tokens).agg(*funnel_counts(F.col("reason")))


def file_report(df: DataFrame, file_col: str, passed_col: str = "passed") -> DataFrame:
    """Kept rows, all rows and percentage kept for each input file."""
    kept, total = F.count_if(F.col(passed_col)), F.count(F.lit(1))
    return df.groupBy(file_col).agg(
        kept.alias("kept"),
        total.alias("total"),
        F.round(F.try_divide(kept * 100.0, total), 1).alias("kept_percent"),
    )
