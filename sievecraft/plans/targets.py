"""Target vectors for label sequences: one per sample, or one per anchor position."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.functions.labels import MIN_SUFFIX_TOKENS
from sievecraft.operators.embed import KEY, MAX_LENGTH, VECTOR, attach_embeddings, content_key, embed_incremental
from sievecraft.operators.labels import decode_responses, distinct_windows, keyed_windows, suffix_loads, suffix_sources, with_pieces
from sievecraft.operators.skew import join_unique


def sample_targets(
    df: DataFrame,
    vocabulary: DataFrame,
    sample: Sequence[str],
    make_encoder: Callable[[], Callable],
    encoder_name: str,
    dim: int,
    cache_path: str,
    max_len: int | None = MAX_LENGTH,
    sep: str = "",
) -> DataFrame:
    """(sample, text, content_key, embedding) of each whole response.

    Texts the table at ``cache_path`` knows are not encoded again; new vectors
    are added to it.
    """
    texts = decode_responses(df, vocabulary, sample, sep)
    vectors = embed_incremental(texts, "text", make_encoder, encoder_name, dim, cache_path, max_len)
    return attach_embeddings(texts, vectors, "text", encoder_name, sample, max_len)


def suffix_targets(
    df: DataFrame,
    vocabulary: DataFrame,
    sample: Sequence[str],
    make_encoder: Callable[[], Callable],
    encoder_name: str,
    dim: int,
    cache_path: str,
    k: int,
    stride: int = 1,
    min_len: int = MIN_SUFFIX_TOKENS,
    max_len: int | None = MAX_LENGTH,
    sep: str = "",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anchor vectors, sources and loads.

    Anchors are (sample, pos, content_key, embedding); sources (sample, pos, src_pos,
    has_target) tell which anchor serves each response position; loads (sample,
    src_pos, n) how many each serves. Join on (sample, src_pos) where the vectors
    themselves are wanted. Tokens do not leave their row; texts are built, and encoded,
    once for each different window of all samples.
    """
    rows = with_pieces(df, vocabulary, sample)
    windows = keyed_windows(rows, sample, k, stride, min_len)
    texts = distinct_windows(windows, sep).withColumn(KEY, content_key(F.col("text"), encoder_name, max_len))
    vectors = embed_incremental(texts, "text", make_encoder, encoder_name, dim, cache_path, max_len)
    encoded = texts.select("window_key", KEY).join(vectors.select(KEY, VECTOR), KEY)
    anchors = join_unique(windows.select(*sample, "pos", "window_key"), encoded, "window_key", [*sample, "pos"])
    found = anchors.select(*sample, "pos", KEY, VECTOR)
    return found, suffix_sources(rows, sample, k, stride, min_len), suffix_loads(rows, sample, k, stride, min_len)
