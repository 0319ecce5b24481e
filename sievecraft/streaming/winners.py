"""A table of the best row per key that a stream keeps up to date.

The table is cut into hash buckets of the key. A micro-batch chooses its own winners,
merges them into the buckets they fall into, writes these anew, and commits the new
versions together with the number of the batch. The table grows with the keys, not
with the batches; a replayed batch finds its number taken and changes nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sievecraft.operators.dedup import keep_best
from sievecraft.sources.commits import CommitLog

BUCKETS = 64
_BUCKET = "_bucket"
_ATTEMPTS = 100


def _log(spark: SparkSession, table: str) -> CommitLog:
    return CommitLog(spark, f"{table}/_commits")


def merge_winners(
    batch: DataFrame, batch_id: int, run: str, key: Column, rank: Sequence[Column], seq: Sequence[str], table: str, buckets: int = BUCKETS
) -> None:
    """Merges one batch of ``run`` into ``table``; batches of a run come in ascending order.

    Two runs may write at once. Of two that touch the same bucket one commits first,
    and the other merges into what it left. Superseded versions are deleted one commit
    later, so that whoever reads the version before finds it. The number of buckets is
    fixed by the first commit.
    """
    spark, columns = batch.sparkSession, batch.columns
    log = _log(spark, table)
    number, state = log.latest()
    buckets = state.get("buckets", buckets)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    best = keep_best(batch, key, rank, seq).withColumn(_BUCKET, bucket).persist()
    try:
        touched = sorted(r[0] for r in best.select(_BUCKET).distinct().collect())
        merged: tuple[list[str | None], str] | None = None
        for _ in range(_ATTEMPTS):
            if state.get("runs", {}).get(run, -1) >= batch_id:
                return
            versions = dict(state.get("versions", {}))
            before = [versions.get(str(b)) for b in touched]
            if merged is None or merged[0] != before:
                old = [p for p in before if p]
                rows = best.select(*columns)
                if old:
                    rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*old))
                path = f"{table}/data/{uuid.uuid4().hex}"
                if touched:
                    # a row that two runs have read is there twice
                    keep_best(rows, key, rank, seq).dropDuplicates(list(seq)).withColumn(_BUCKET, bucket).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(path)
                merged = before, path
            value = {
                "buckets": buckets,
                "runs": state.get("runs", {}) | {run: batch_id},
                "versions": versions | {str(b): f"{merged[1]}/{_BUCKET}={b}" for b in touched},
                "replaced": [p for p in before if p],
                "schema": rows.schema.jsonValue(),
            }
            if log.commit(number + 1, value):
                log.remove(state.get("replaced", []))
                return
            number, state = log.latest()
    finally:
        best.unpersist()
    raise RuntimeError(f"{table}: no commit in {_ATTEMPTS} attempts")


def upsert_winners(
    df: DataFrame, key: Column, rank: Sequence[Column], seq: Sequence[str], table: str, checkpoint: str, run_id: str | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keeps ``table`` at the best row per key of everything the stream has brought, until it is drained.

    ``run_id`` names the run in the commits; it comes from the checkpoint's path if none
    is given. Give a new one when a checkpoint was lost.
    """
    run = run_id or hashlib.md5(checkpoint.encode()).hexdigest()

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_winners(batch, batch_id, run, key, rank, seq, table, buckets)

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def winners(spark: SparkSession, table: str) -> DataFrame:
    """The best row per key as of the latest commit."""
    number, state = _log(spark, table).latest()
    if number < 0:
        raise FileNotFoundError(f"{table} has no commit")
    schema = StructType.fromJson(state["schema"])
    paths = list(state["versions"].values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
