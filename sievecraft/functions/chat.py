"""Chat messages built inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievecraft.functions.text import est_tokens, is_blank, strip

# Fixed values of the message format.
STARTER_HEADING = "Starter code:"
CODE_FENCE = "python"
CODE_PROBE_CHARS = 50
CODE_TAIL_CHARS = 500


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def fenced(code: Column) -> Column:
    return F.concat(F.lit(f"```{CODE_FENCE}\n"), code, F.lit("\n```"))


def system_chat(system_prompt: str, user: Column, assistant: Column) -> Column:
    """System, user and assistant message; the prompt is stripped, the rest raw."""
    return F.array(
        message("system", strip(F.lit(system_prompt))),
        message("user", user),
        message("assistant", assistant),
    )


def has_code(response: Column, code: Column) -> Column:
    """The head of the code occurs literally near the end of the response."""
    tail = F.right(response, F.length(code) + CODE_TAIL_CHARS)
    return F.contains(tail, F.left(strip(code), F.lit(CODE_PROBE_CHARS)))


def user_content(question: Column, starter: Column) -> Column:
    extra = F.concat(F.lit(f"\n\n{STARTER_HEADING}\n"), fenced(starter))
    return F.concat(question, F.when(is_blank(starter), F.lit("")).otherwise(extra))


def assistant_content(response: Column, code: Column) -> Column:
    skip = is_blank(code) | has_code(response, code)
    return F.concat(response, F.when(skip, F.lit("")).otherwise(F.concat(F.lit("\n\n"), fenced(code))))


def code_chat(question: Column, response: Column, code: Column, starter: Column) -> Column:
    return F.array(
        message("user", user_content(question, starter)),
        message("assistant", assistant_content(response, code)),
    )


def length_metadata(question: Column, response: Column, code: Column) -> Column:
    """Lengths of the original texts, not of the messages built from them."""
    return F.struct(
        F.length(question).alias("question_length"),
        F.length(response).alias("response_length"),
        F.length(code).alias("code_length"),
        est_tokens(response).cast("int").alias("cot_tokens"),
    )
