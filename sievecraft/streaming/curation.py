"""The curation jobs on an unbounded input.

Filters and chat building are stateless: ``keep_verified``, ``passing_instructions``,
``to_chat_records`` and ``to_messages`` take a streaming DataFrame as they are. What
needs care is dedup, since a stream never knows all copies of a key. The first arrival is
decided here; for the best copy see ``winners``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievecraft.sources.corpus import matching_folders


def stream_corpus(
    spark: SparkSession, path: str, schema: StructType | str, pattern: str = "train-*.parquet", files_per_trigger: int = 1000
) -> DataFrame:
    """Parquet files of a folder as they arrive.

    Where folders of part files match ``pattern`` when the stream starts, their files are
    taken, and those of matches that come later.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if matching_folders(spark, path, pattern):
        return reader.parquet(f"{path}/{pattern}")
    return reader.option("pathGlobFilter", pattern).parquet(path)


def stream_keep_first(df: DataFrame, key: Column, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First arrival per key.

    "First" is arrival here, where the batch operator goes by scan order. Without
    an event time the state holds every key ever seen; with one it holds the keys
    of the last ``delay``.
    """
    keyed = df.withColumn("dedup_key", key)
    if event_time is None:
        return keyed.dropDuplicates(["dedup_key"])
    return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["dedup_key"])
