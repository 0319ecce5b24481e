"""Target preparation from label sequences.

Inputs hold one row per sample with an array column ``labels``; ``sample`` names
the identifying columns. Long results have one row per (sample, position).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.dictionary import token_dictionary
from sievecraft.functions.labels import (
    IGNORE_INDEX,
    MIN_SUFFIX_TOKENS,
    anchor_loads,
    anchor_positions,
    nearest_anchors,
    own_targets,
    position_weights,
    suffix_ids,
    window_key,
)
from sievecraft.functions.text import is_blank, let
from sievecraft.operators.skew import join_unique
from sievecraft.session import stored

LABELS, PIECES = "labels", "pieces"
# Of a vocabulary that is looked up in the row. As a constant it is in every copy of the
# plan and in every task: one of 10 MB takes the driver more than 1.5 GB.
PLAN_BYTES = 1 << 20


def _visible(df: DataFrame) -> Column | None:
    """Which positions of a row with ``pieces`` show something; None for rows without."""
    return F.transform(PIECES, lambda p: p.isNotNull() & ~is_blank(p)) if PIECES in df.columns else None


def response_tokens(df: DataFrame, sample: Sequence[str]) -> DataFrame:
    """(sample, pos, token_id) of the response positions."""
    exploded = df.select(*sample, F.posexplode(LABELS).alias("pos", "token_id"))
    return exploded.where(F.col("token_id") != IGNORE_INDEX)


def with_pieces(df: DataFrame, vocabulary: DataFrame, sample: Sequence[str], limit: int = PLAN_BYTES) -> DataFrame:
    """(sample, labels, pieces): each response token's text at its position, else null.

    Special tokens have no text. A vocabulary of up to ``limit`` bytes is looked up in
    the row, and no token moves; a larger one is joined, and the rows are written to the
    shared folder, so that what reads them again does not join again.
    """
    dictionary = token_dictionary(vocabulary, limit)
    if dictionary is None:
        return stored(joined_pieces(df, vocabulary, sample), "pieces")
    pieces = F.transform(LABELS, lambda x: F.when(x != IGNORE_INDEX, dictionary.piece(x)))
    return df.select(*sample, LABELS, pieces.alias(PIECES))


def joined_pieces(df: DataFrame, vocabulary: DataFrame, sample: Sequence[str]) -> DataFrame:
    """``with_pieces`` for a vocabulary of any size.

    Every response token meets the vocabulary once. Frequent tokens are hot keys of that
    join and are salted there; prompt positions stay behind and are put back as the gaps
    between the others. Rows that share a ``sample`` are told apart by their labels;
    equal ones go as one and are repeated at the end.
    """
    kind = df.schema[LABELS].dataType.elementType
    row = [*sample, "_row"]
    tokens = F.filter(
        F.transform(LABELS, lambda x, i: F.struct(i.alias("pos"), x.alias("label"))), lambda t: ~t["label"].eqNullSafe(IGNORE_INDEX)
    )
    long = df.select(*sample, F.xxhash64(LABELS).alias("_row"), F.size(LABELS).alias("_length"), F.explode_outer(tokens).alias("_token"))
    keyed = long.select(*row, "_length", "_token.pos", F.col("_token.label").alias("token_id"))
    texts = vocabulary.select("token_id", F.when(~F.col("is_special"), F.col("piece")).alias("piece"))
    joined = join_unique(keyed, texts, "token_id", [*row, "pos"]).repartition(*row)
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "token_id", "piece"))
    grouped = joined.groupBy(*row).agg(
        F.sort_array(F.collect_set(entry)).alias("_tokens"), F.max("_length").alias("_length"), F.count(F.lit(1)).alias("_n")
    )

    def filled(found: Column, name: str, gap: Column) -> Column:
        def at(t: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(-1)).otherwise(F.get(found, i - 1)["pos"])
            return F.concat(F.array_repeat(gap, t["pos"] - before - 1), F.array(t[name]))

        last = F.when(F.size(found) > 0, F.get(found, F.size(found) - 1)["pos"]).otherwise(F.lit(-1))
        return F.concat(F.flatten(F.transform(found, at)), F.array_repeat(gap, F.col("_length") - last - 1))

    def rebuilt(found: Column) -> Column:
        labels = filled(found, "token_id", F.lit(IGNORE_INDEX).cast(kind))
        pieces = filled(found, "piece", F.lit(None).cast("string"))
        copies = F.expr("_n").cast("double") / F.greatest(F.size(found), F.lit(1))
        whole = F.when(F.col("_length") >= 0, F.struct(labels.alias(LABELS), pieces.alias(PIECES)))
        return F.array_repeat(whole, copies.cast("int"))

    return grouped.select(*sample, F.explode(let(F.col("_tokens"), rebuilt)).alias("_whole")).select(*sample, f"_whole.{LABELS}", f"_whole.{PIECES}")


def decode_responses(df: DataFrame, vocabulary: DataFrame, sample: Sequence[str], sep: str = "") -> DataFrame:
    """(sample, text): the response pieces in order; the empty text without response."""
    return with_pieces(df, vocabulary, sample).select(*sample, F.array_join("pieces", sep).alias("text"))


def _anchors(df: DataFrame, k: int, stride: int, min_len: int) -> Column:
    return anchor_positions(F.col(LABELS), k, stride, min_len, F.col("_visible") if PIECES in df.columns else None)


def _with_visible(df: DataFrame) -> DataFrame:
    visible = _visible(df)
    return df if visible is None else df.withColumn("_visible", visible)


def suffix_windows(df: DataFrame, sample: Sequence[str], k: int, stride: int = 1, min_len: int = MIN_SUFFIX_TOKENS) -> DataFrame:
    """(sample, pos, suffix): the token windows an encoder has to see.

    Windows without visible text are left out if the rows have ``pieces``.
    """
    windows = F.transform(_anchors(df, k, stride, min_len), lambda p: F.struct(p.alias("pos"), suffix_ids(F.col(LABELS), p, k).alias("suffix")))
    return _with_visible(df).select(*sample, F.inline(windows))


def keyed_windows(df: DataFrame, sample: Sequence[str], k: int, stride: int = 1, min_len: int = MIN_SUFFIX_TOKENS) -> DataFrame:
    """(sample, pos, window_key, pieces) of the windows of rows that have ``pieces``.

    The key is that of the token ids, so equal windows of all samples are known before
    any text is built.
    """
    offsets = F.sequence(F.lit(1), F.lit(k))

    def window(p: Column) -> Column:
        seen = F.filter(F.transform(offsets, lambda o: F.get(F.col(PIECES), p + o)), lambda x: x.isNotNull())
        return F.struct(p.alias("pos"), window_key(suffix_ids(F.col(LABELS), p, k)).alias("window_key"), seen.alias(PIECES))

    return _with_visible(df).select(*sample, F.inline(F.transform(_anchors(df, k, stride, min_len), window)))


def distinct_windows(windows: DataFrame, sep: str = "") -> DataFrame:
    """(window_key, text): each different window once, its text built after the others are gone."""
    once = windows.groupBy("window_key").agg(F.any_value(PIECES).alias(PIECES))
    return once.select("window_key", F.array_join(PIECES, sep).alias("text"))


def suffix_sources(df: DataFrame, sample: Sequence[str], k: int, stride: int = 1, min_len: int = MIN_SUFFIX_TOKENS) -> DataFrame:
    """(sample, pos, src_pos, has_target) of every response position.

    ``src_pos`` is the anchor whose suffix vector stands for the position: a
    reference to it instead of a copy of the vector. With stride 1 nothing is
    filled in; with a larger stride the nearest anchor serves.
    """
    labels = F.col(LABELS)
    if stride == 1:
        sources = own_targets(labels, k, min_len, F.col("_visible") if PIECES in df.columns else None)
    else:
        sources = nearest_anchors(labels, _anchors(df, k, stride, min_len))
    long = _with_visible(df).select(*sample, F.inline(sources))
    return long.withColumn("has_target", F.col("src_pos").isNotNull())


def suffix_loads(df: DataFrame, sample: Sequence[str], k: int, stride: int = 1, min_len: int = MIN_SUFFIX_TOKENS) -> DataFrame:
    """(sample, src_pos, n): the number of response positions that each anchor serves.

    What counting the rows of ``suffix_sources`` by anchor gives, without the rows.
    """
    anchors = _anchors(df, k, stride, min_len)
    if stride == 1:
        loads = F.transform(anchors, lambda p: F.struct(p.alias("src_pos"), F.lit(1).cast("long").alias("n")))
    else:
        loads = anchor_loads(F.col(LABELS), anchors)
    return _with_visible(df).select(*sample, F.inline(loads))


def weigh_positions(df: DataFrame, sample: Sequence[str]) -> DataFrame:
    """(sample, pos, rank, weight) of every response position."""
    return df.select(*sample, F.inline(position_weights(F.col(LABELS))))


def weighted_mean(df: DataFrame, loss: Column, weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of a loss; the weights count as 1 where they sum to less."""
    total = F.greatest(F.sum(weight), F.lit(1.0))
    return df.groupBy(*by).agg((F.sum(loss * weight) / total).alias("weighted_loss"))
