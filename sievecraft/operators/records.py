"""Training records from curated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.chat import code_chat, length_metadata, system_chat


def to_messages(df: DataFrame, system_prompt: str, *keep: str) -> DataFrame:
    """``messages`` with a system, a user and an assistant turn."""
    chat = system_chat(system_prompt, F.col("input"), F.col("output"))
    return df.select(*keep, chat.alias("messages"))


def to_chat_records(df: DataFrame, *keep: str) -> DataFrame:
    """``id``, ``conversations`` and ``metadata`` from rows with filled texts."""
    q, r, c, s = (F.col(n) for n in ("question", "response", "code", "starter_code"))
    return df.select(
        F.col("question_id").alias("id"),
        code_chat(q, r, c, s).alias("conversations"),
        length_metadata(q, r, c).alias("metadata"),
        *keep,
    )
