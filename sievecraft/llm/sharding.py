"""Uniform shuffle into shards of exact size.

The rows lie in source blocks. A communication matrix says how many rows each
block sends to each shard; it is drawn from the multivariate hypergeometric law
that a uniform random permutation of all rows would follow. Every block permutes
its rows and cuts them by its line of the matrix, the rows are exchanged, and
every shard permutes what it got.

Only the matrix (blocks x shards counts, at most ``max_blocks`` lines) passes
through the driver. Rows are ordered inside blocks and inside slices of a shard,
never in a whole shard, so a task sorts a bounded share whatever the input size.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.llm.common import free_name, stored, table

SHARDS, SEED = 16, 20240229


def draw_hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """Number of good ones among ``n`` draws without replacement.

    The distribution function is walked outwards from its mode, so the cost is a
    few standard deviations, and the population has no upper limit.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    p_mode = math.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    left = rng.random() - p_mode
    if left < 0:
        return mode
    up, down, p_up, p_down = mode, mode, p_mode, p_mode
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            left -= p_up
            if left < 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            left -= p_down
            if left < 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode  # only rounding of the last bits gets here


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts per block and shard with the given sums, as under a uniform permutation."""
    rng, free, matrix = random.Random(seed), list(shards), []
    for rows in blocks:
        line, left, pool = [], rows, sum(free)
        for j, room in enumerate(free):
            pool -= room
            take = draw_hypergeometric(rng, room, pool, left)
            line.append(take)
            left -= take
            free[j] -= take
        matrix.append(line)
    return matrix


def shuffle_to_shards(
    df: DataFrame,
    keys: list[str],
    shards: int = SHARDS,
    seed: int = SEED,
    rows_per_block: int = 2048,
    max_blocks: int = 4096,
) -> DataFrame:
    """Add ``shard`` (sizes at most one apart) and ``slot`` (gapless from 0 in a shard).

    ``keys`` identify a row; equal keys are interchangeable, so repeated rows get
    a slot each. Null keys hash like any value. An empty table gives no row.
    Columns named ``shard`` or ``slot`` are replaced.
    """
    df = df.drop("shard", "slot")
    block, local, place, part, ends = free_name(df, "block", "local", "place", "part", "ends")
    n = df.count()
    blocks = max(1, min(max_blocks, math.ceil(n / rows_per_block)))
    dealt = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(blocks)).cast("int")

    counted = df.select(dealt.alias("b")).groupBy("b").count().collect()
    sizes = {r["b"]: r["count"] for r in counted}
    matrix = communication_matrix(
        [sizes.get(b, 0) for b in range(blocks)],
        [n // shards + (j < n % shards) for j in range(shards)],
        seed,
    )
    spark = df.sparkSession
    lines = spark.sql(
        f"SELECT posexplode(from_json(:m, 'array<array<bigint>>')) AS ({block}, {ends})",
        args={"m": json.dumps([[sum(line[: j + 1]) for j in range(shards)] for line in matrix])},
    )
    in_block = Window.partitionBy(block).orderBy(local, *keys)
    sent = (
        df.withColumn(block, dealt)
        .withColumn(local, F.xxhash64(F.lit(seed + 1), *keys))
        .withColumn(place, F.row_number().over(in_block).cast("long"))
        .join(F.broadcast(lines), block)
        .withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col(place))))
        .drop(block, local, place, ends)
    )
    # the second permutation, in slices of the shard's random order
    bits = max(1, min(12, math.ceil(math.log2(max(1, n / shards / rows_per_block))) or 1))
    sent = stored(
        sent.withColumn(local, F.xxhash64(F.lit(seed + 2), *keys)).withColumn(
            part, F.shiftrightunsigned(local, 64 - bits).cast("int")
        ),
        "sharded",
    )
    before = (
        sent.groupBy("shard", part)
        .agg(F.count("*").alias("rows"))
        .select(
            "shard",
            part,
            (
                F.sum("rows").over(Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, 0))
                - F.col("rows")
            ).alias(ends),
        )
    )
    in_slice = Window.partitionBy("shard", part).orderBy(local, *keys)
    return (
        sent.withColumn(place, F.row_number().over(in_slice))
        .join(F.broadcast(before), ["shard", part])
        .withColumn("slot", F.col(ends) + F.col(place) - 1)
        .drop(part, local, place, ends)
    )


def op8_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts (law ``rows``)."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shuffle_to_shards(rows, ["doc_id", "text_crc32", "size"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op8_hypergeometric_sharding": op8_hypergeometric_sharding}
ORACLE: dict[str, str] = {}
