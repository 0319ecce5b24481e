"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, nulls and non-ASCII text kept."""
    df.write.mode(mode).options(**_KEEP_NULLS).json(path)


def json_array_text(df: DataFrame, order: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """``value``: the pieces of one pretty JSON array, in ``order``.

    ``order`` must identify a row; columns in ``drop`` only order. The first and last row, found by an
    aggregate, carry the brackets; every other row carries its own comma. So the
    pieces can be written by as many tasks as there are range partitions, and
    the part files, concatenated in name order, are the array.
    """
    pos = F.struct(*order)
    first = df.select(F.min(pos)).scalar()
    last = df.select(F.max(pos)).scalar()
    body = F.to_json(F.struct(*[c for c in df.columns if c not in drop]), {"pretty": "true", **_KEEP_NULLS})
    pieces = df.orderBy(*order).select(
        F.concat(
            F.when(pos == first, F.lit("[\n")).otherwise(F.lit("")),
            body,
            F.when(pos == last, F.lit("\n]")).otherwise(F.lit(",")),
        ).alias("value")
    )
    # An empty input still is an array: this row exists only then.
    empty = df.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("[]").alias("value"))
    return pieces.unionAll(empty)


def write_json_array(
    df: DataFrame, path: str, order: Sequence[str], drop: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Part files that, concatenated in name order, form one pretty JSON array."""
    json_array_text(df, order, drop).write.mode(mode).text(path)
