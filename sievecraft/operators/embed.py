"""Text encoding with a table of earlier results, pooling, attachment."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sievecraft.functions.ordering import seeded_normal_vector, seeded_uniform
from sievecraft.functions.vectors import doubles, interpolate, l2_normalize, velocity, zero_vector
from sievecraft.operators.skew import join_unique
from sievecraft.session import stored
from sievecraft.sources.commits import CommitLog

# Fixed values.
MAX_LENGTH = 512
BATCH_SIZE = 512
TOKEN_BUDGET = 1 << 16  # padded tokens of a batch
BLOCK_TOKENS = 1 << 18  # tokens whose vectors a task holds at once
POOL_ROWS = 1 << 15  # vectors that are added up in one step

KEY = "content_key"
VECTOR = "embedding"
_ATTEMPTS = 100


def content_key(text: Column, encoder_name: str, max_len: int | None) -> Column:
    """What a vector depends on: the encoder, its length limit, the text."""
    return F.md5(F.concat(F.lit(f"{encoder_name}|{max_len}|"), text))


def budget_batches(lengths: Sequence[int], batch_size: int, token_budget: int | None) -> Iterator[list[int]]:
    """Positions in batches of similar length, longest first.

    A batch has at most ``batch_size`` texts and, padded to its longest, at most
    ``token_budget`` tokens; a text of more tokens than that is alone. In order of
    length, texts differ little from their neighbours, so little of a batch is padding.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    start = 0
    while start < len(order):
        longest = max(1, lengths[order[start]])
        count = batch_size if token_budget is None else min(batch_size, max(1, token_budget // longest))
        yield order[start : start + count]
        start += count


def encode_texts(
    text: Column,
    make_encoder: Callable[[], Callable],
    dim: int,
    max_len: int | None = MAX_LENGTH,
    batch_size: int = BATCH_SIZE,
    token_budget: int | None = TOKEN_BUDGET,
    count_tokens: Callable[[str], int] | None = None,
) -> Column:
    """Unit vectors of texts; blank text gives the zero vector.

    ``make_encoder()`` runs once per Python worker and returns a callable
    ``(list of texts, max_len) -> 2-d array``. It only sees non-blank texts, in batches
    of similar length, see ``budget_batches``. ``count_tokens`` tells how long a text is
    before the length limit; the number of its words by default.
    """
    batches_of = budget_batches

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        length = count_tokens or (lambda t: len(t.split()))
        for texts in batches:
            vectors = [[0.0] * dim] * len(texts)
            visible = [i for i, t in enumerate(texts) if t and not t.isspace()]
            lengths = [length(texts.iloc[i]) for i in visible]
            if max_len is not None:
                lengths = [min(n, max_len) for n in lengths]
            for batch in batches_of(lengths, batch_size, token_budget):
                part = [visible[k] for k in batch]
                for i, vector in zip(part, encoder([texts.iloc[i] for i in part], max_len)):
                    vectors[i] = vector
            yield pd.Series(vectors)

    return l2_normalize(F.pandas_udf(encode, "array<double>")(text))


def encode_new(
    df: DataFrame,
    text_col: str,
    make_encoder: Callable[[], Callable],
    encoder_name: str,
    dim: int,
    known: DataFrame | None = None,
    max_len: int | None = MAX_LENGTH,
    partitions: int | None = None,
) -> DataFrame:
    """(content_key, embedding) of the texts ``known`` has no vector for.

    Equal texts are encoded once. Encoding is by far the dearest step and its
    cost has little to do with bytes, so ``partitions`` can spread it wider than
    the shuffle would.
    """
    keyed = df.select(content_key(F.col(text_col), encoder_name, max_len).alias(KEY), F.col(text_col).alias("_text"))
    distinct = keyed.where(F.col("_text").isNotNull()).dropDuplicates([KEY])
    todo = distinct if known is None else distinct.join(known.select(KEY), KEY, "left_anti")
    if partitions:
        todo = todo.repartition(partitions, KEY)
    return todo.select(KEY, encode_texts(F.col("_text"), make_encoder, dim, max_len).alias(VECTOR))


def _vector_files(spark: SparkSession, table: str) -> tuple[CommitLog, int, list[str]]:
    log = CommitLog(spark, f"{table}/_commits")
    number, state = log.latest()
    return log, number, state.get("files", [])


def read_vectors(spark: SparkSession, table: str) -> DataFrame | None:
    """The vectors of the last commit to ``table``, or None where there is none yet."""
    files = _vector_files(spark, table)[2]
    return spark.read.parquet(*files) if files else None


def append_vectors(new: DataFrame, table: str, seen: int, known: Sequence[str]) -> DataFrame:
    """Adds ``new`` (content_key, embedding) to ``table`` and returns all vectors.

    ``new`` holds no key of the ``known`` files, those of commit ``seen``. If other jobs
    have committed since, their keys are taken out of the new vectors before these are
    committed, so each key stays in the table once. Files carry a Bloom filter of their
    keys, which lets a look-up of few keys skip most of them.
    """
    spark, log = new.sparkSession, CommitLog(new.sparkSession, f"{table}/_commits")

    def written(df: DataFrame) -> str:
        path = f"{table}/data/{uuid.uuid4().hex}"
        df.write.option(f"parquet.bloom.filter.enabled#{KEY}", "true").parquet(path)
        return path

    known, mine = list(known), written(new)
    for _ in range(_ATTEMPTS):
        if log.commit(seen + 1, {"files": [*known, mine]}):
            return spark.read.parquet(*known, mine)
        seen, state = log.latest()
        added = [f for f in state["files"] if f not in known]
        theirs = spark.read.parquet(*added).select(KEY)
        before, mine = mine, written(spark.read.parquet(mine).join(theirs, KEY, "left_anti"))
        log.remove([before])
        known = state["files"]
    raise RuntimeError(f"{table}: no commit in {_ATTEMPTS} attempts")


def embed_incremental(
    df: DataFrame,
    text_col: str,
    make_encoder: Callable[[], Callable],
    encoder_name: str,
    dim: int,
    cache_path: str,
    max_len: int | None = MAX_LENGTH,
    partitions: int | None = None,
) -> DataFrame:
    """Brings the vector table at ``cache_path`` up to date and returns it.

    Any number of jobs may do so at once. A text the table holds is never encoded again,
    which only its keys are read for; one that two jobs encode at the same time is kept
    once. A text encoded under another name or length limit is never mistaken for this
    one.
    """
    _, seen, files = _vector_files(df.sparkSession, cache_path)
    known = df.sparkSession.read.parquet(*files) if files else None
    new = encode_new(df, text_col, make_encoder, encoder_name, dim, known, max_len, partitions)
    return append_vectors(new, cache_path, seen, files)


def attach_embeddings(
    df: DataFrame,
    vectors: DataFrame,
    text_col: str,
    encoder_name: str,
    row_id: Sequence[str],
    max_len: int | None = MAX_LENGTH,
) -> DataFrame:
    """Each row with the vector of its text; a text many rows share is salted."""
    keyed = df.withColumn(KEY, content_key(F.col(text_col), encoder_name, max_len))
    return join_unique(keyed, vectors.select(KEY, VECTOR), KEY, row_id)


def mean_pool(df: DataFrame, by: Sequence[str], vector: str, weight: str | None = None) -> DataFrame:
    """(by, pooled): the mean vector of each group, weighted if asked.

    Partial sums are one vector per group and task. Rows of weight 0 are left
    out, as padding is.
    """
    used = df if weight is None else df.where(F.col(weight) > 0)
    v = array_to_vector(doubles(F.col(vector)))
    mean = Summarizer.mean(v) if weight is None else Summarizer.mean(v, F.col(weight).cast("double"))
    return used.groupBy(*by).agg(vector_to_array(mean).alias("pooled"))


def _pool_blocks(sample: Sequence[str], key: str, vector: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The mean vector of each sample of a block, from the vectors that the block needs."""

    def pool(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([*(left.schema.field(c) for c in sample), pa.field("pooled", pa.list_(pa.float64()))])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        lists = pa.chunked_array(right[vector].chunks).combine_chunks()
        sizes = pc.unique(lists.value_lengths()).to_pylist()
        if len(sizes) > 1 or sizes[0] is None:
            raise ValueError(f"vectors of different lengths: {sizes}")
        width = sizes[0]
        names = pa.chunked_array(right[key].chunks).combine_chunks().dictionary_encode()
        at = names.indices.to_numpy()
        times = np.bincount(at, minlength=len(names.dictionary)).astype(np.float64)
        sums = np.zeros((len(times), width))  # of the vectors of a key; more than one if the table repeats it
        np.add.at(sums, at, lists.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width))
        keys = pa.chunked_array(left["_keys"].chunks).combine_chunks()
        code = pc.index_in(keys.flatten(), value_set=names.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy(zero_copy_only=False))[code >= 0]
        code = code[code >= 0]
        held, start = np.unique(owner, return_index=True)
        pooled = np.zeros((len(held), width))
        ends = np.append(start[1:], len(code))
        first = 0
        while first < len(held):
            last = max(first + 1, int(np.searchsorted(ends, start[first] + POOL_ROWS, "right")))
            low, high = start[first], ends[last - 1]
            pooled[first:last] = np.add.reduceat(sums[code[low:high]], start[first:last] - low, axis=0)
            first = last
        if len(held):
            pooled /= np.add.reduceat(times[code], start)[:, None]
        offsets = pa.array(np.arange(len(held) + 1) * width, pa.int32())
        columns = [left[c].take(pa.array(held)) for c in sample]
        columns.append(pa.ListArray.from_arrays(offsets, pa.array(pooled.ravel())))
        return pa.Table.from_arrays(columns, schema=out)

    return pool


def table_encode(
    tokens: DataFrame, vectors: DataFrame, sample: Sequence[str], key: str, dim_vector: str = VECTOR
) -> DataFrame:
    """(sample, embedding): unit mean of the table vectors of a sample's tokens.

    Samples are dealt in their order to blocks of about ``BLOCK_TOKENS`` tokens, and each
    block gets every vector it needs once, however many of its samples and tokens have
    it: what moves are keys, and vectors by block, never a vector for each token.
    """
    kind = tokens.select(key).union(vectors.select(key)).schema[0].dataType
    rows = stored(tokens.groupBy(*sample).agg(F.collect_list(F.col(key).cast(kind)).alias("_keys")), "token-rows")
    total = rows.agg(F.sum(F.size("_keys"))).first()[0] or 0
    blocks = rows.repartitionByRange(-(-total // BLOCK_TOKENS) or 1, *sample).withColumn("_block", F.spark_partition_id())
    dealt = stored(blocks, "token-blocks")
    needed = dealt.select(F.col("_block").alias("_of"), F.explode(F.array_distinct("_keys")).alias(key)).distinct()
    found = needed.join(vectors.select(F.col(key).cast(kind).alias(key), dim_vector), key)
    schema = StructType([*rows.select(*sample).schema, StructField("pooled", ArrayType(DoubleType()))])
    pooled = dealt.groupBy("_block").cogroup(found.groupBy("_of")).applyInArrow(_pool_blocks(sample, key, dim_vector), schema)
    return pooled.select(*sample, l2_normalize(F.col("pooled")).alias(VECTOR))


def embed_samples(df: DataFrame, encoded: DataFrame, sample: Sequence[str], dim: int) -> DataFrame:
    """Every sample with its vector, the zero vector where nothing was encoded."""
    return df.join(encoded, list(sample), "left").withColumn(VECTOR, F.coalesce(VECTOR, zero_vector(dim)))


def sample_vector_positions(df: DataFrame, positions: Column, row: Sequence[str]) -> DataFrame:
    """One target for all positions of a sample, as a reference to its content key.

    ``df`` has one row per sample with ``content_key``; ``positions`` is the array of
    its positions, opened last, so that no position is shuffled.
    """
    return df.select(*row, KEY, F.explode(positions).alias("pos"))


def mean_over_positions(loads: DataFrame, lengths: DataFrame, vectors: DataFrame, sample: Sequence[str], dim: int) -> DataFrame:
    """(sample, pooled): sum of the position targets over the full sequence length.

    ``loads`` has the number of positions that each anchor serves; positions without a
    target and prompt positions count as zero vectors. A vector is weighted by that
    number instead of being copied, and moves once, to the place of its sample.
    """
    anchor = [*sample, "src_pos"]
    numbers = loads.where("n > 0").select(*anchor, "n", F.lit(None).cast(vectors.schema[VECTOR].dataType).alias(VECTOR))
    both = numbers.unionByName(vectors.select(*sample, F.col("pos").alias("src_pos"), F.lit(None).cast("bigint").alias("n"), VECTOR))
    met = both.dropna(subset=anchor).repartition(*sample).groupBy(*anchor).agg(F.sum("n").alias("n"), F.collect_list(VECTOR).alias("_all"))
    joined = met.where("n IS NOT NULL").select(*sample, "n", F.explode("_all").alias(VECTOR))
    weighted = Summarizer.sum(array_to_vector(doubles(F.col(VECTOR))), F.col("n").cast("double"))
    sums = joined.groupBy(*sample).agg(vector_to_array(weighted).alias("_sum"))
    filled = lengths.join(sums, list(sample), "left").withColumn("_sum", F.coalesce("_sum", zero_vector(dim)))
    return filled.select(*sample, F.transform("_sum", lambda x: x / F.greatest(F.col("length"), F.lit(1))).alias("pooled"))


def interpolation_pairs(
    df: DataFrame, vector: str, sample_key: Column, position_key: Column, dim: int, seed: int = 0
) -> DataFrame:
    """Adds ``t``, ``z_t`` and ``v``: a point between noise and target, and its velocity.

    One ``t`` per sample and one noise vector per position, both fixed by the
    keys and the seed, so a recomputed partition draws the same numbers.
    """
    z1 = F.col(vector)
    return (
        df.withColumn("t", seeded_uniform(sample_key, f"{seed}:t"))
        .withColumn("_z0", seeded_normal_vector(position_key, dim, f"{seed}:z"))
        .withColumn("z_t", interpolate(z1, F.col("_z0"), F.col("t")))
        .withColumn("v", velocity(z1, F.col("_z0")))
        .drop("_z0")
    )
