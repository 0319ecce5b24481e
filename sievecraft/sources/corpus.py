"""Readers. Every corpus row carries its scan position."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievecraft.functions.text import WHITESPACE

# File path, then row within the file: the order a sorted file listing is read in.
SEQ = ("seq_file", "seq_row")


def matching_folders(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Names of the folders in ``path`` that match ``pattern``; none where only files do."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    glob = hadoop.Path(f"{path}/{pattern}")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted(status.getPath().getName() for status in found or [] if status.isDirectory())


def read_corpus(
    spark: SparkSession, path: str, pattern: str = "train-*.parquet", schema: StructType | str | None = None
) -> DataFrame:
    """Parquet files of a folder whose name matches ``pattern``.

    Adds ``file_name`` and the two ``SEQ`` columns. The row position is the one
    stored in the file, so it does not depend on how files are split over tasks.
    With ``schema``, a column some file lacks reads as null. A match may be a folder of
    part files, as Spark writes a table: its name is the ``file_name`` of all its rows.
    """
    folders = matching_folders(spark, path, pattern)
    reader = spark.read if folders else spark.read.option("pathGlobFilter", pattern)
    if schema is not None:
        reader = reader.schema(schema)
    name = F.col("_metadata.file_name")
    if folders:
        folder = F.regexp_extract("_metadata.file_path", f".*/({'|'.join(map(re.escape, folders))})/", 1)
        name = F.when(folder == "", name).otherwise(folder)
    return reader.parquet(f"{path}/{pattern}" if folders else path).select(
        "*",
        name.alias("file_name"),
        F.col("_metadata.file_path").alias(SEQ[0]),
        F.col("_metadata.row_index").alias(SEQ[1]),
    )


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, required: Sequence[str] = ()) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed lines and absent required values raise."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    checked = {
        c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing value: {c}"))).otherwise(F.col(c)) for c in required
    }
    return df.withColumns(checked) if checked else df


def read_prompt(spark: SparkSession, path: str) -> str:
    """A prompt file as one stripped string (a parameter, not data)."""
    return spark.read.text(path, wholetext=True).first()[0].strip(WHITESPACE)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed over all cores, but only if the scan would leave cores idle.

    A table of few, large row groups is read by few tasks, and heavy per-row work
    then runs there alone. A table with splits enough for every core is left as
    it is, so large inputs pay no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
