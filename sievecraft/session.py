"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Settings the jobs in this package were planned for. They are only defaults:
# anything already configured on the builder or by the cluster wins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join whose build partitions all turn out small needs no sort of the
    # (wide) probe side.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # The state of a stream may outgrow the heap.
    _STATE_STORE: _ROCKSDB,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "sievecraft", master: str | None = None, **conf: str) -> SparkSession:
    """Session with this package's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, whatever the session says.

    A stream takes its settings along when it starts; those of the session are put back.
    """
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STATE_STORE)
        else:
            spark.conf.set(_STATE_STORE, before)


_local_roots: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, visible to every executor.

    The root is the session's ``spark.checkpoint.dir``. Only a local-mode
    session without that setting gets a temporary folder; on a cluster a missing
    setting is an error, since executors do not share local disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.conf.get("spark.app.id", "")
        root = _local_roots.get(app) or _local_roots.setdefault(app, tempfile.mkdtemp(prefix="sievecraft-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back, for what is used more than once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
