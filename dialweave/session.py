"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# AQE picks join strategies and splits hot join partitions from measured sizes;
# nothing in this package forces a broadcast of a table that can grow.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # partitions of the advised size, rather than one per core however small
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    # a page deep in a listing sorts on disk instead of keeping all rows before it in memory
    "spark.sql.execution.topKSortFallbackThreshold": "1000000",
    # a page found by a long scan is broadcast when the scan is done, however long it took
    "spark.sql.broadcastTimeout": "36000",
    # frozen frames are removed from the shared folder once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # event ids the feed remembers live on disk, not on the heap
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # recording the Python call site of every expression costs a millisecond each
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(app: str = "dialweave", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors share one disk, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="dialweave-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def freeze(df):
    """Write ``df`` out once, reliably, and go on from the written copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
