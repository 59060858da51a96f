"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Runtime settings the plans rely on.  Shuffle partition counts are left to the
# cluster: AQE coalesces from whatever the session names.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # row_number() <= n is cut before the shuffle for n up to this
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # streaming state beyond the executor heap
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}


def build_session(app_name: str = "clicktide", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the cluster's shared ``spark.checkpoint.dir``.

    Without that setting a local master uses a temporary folder; any other
    raises, as its executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{name}-{uuid4().hex}"
    if not is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"{name}-")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")
