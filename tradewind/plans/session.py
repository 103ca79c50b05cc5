"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change neither results nor resources, only plans; safe to set
# on a session somebody else created.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Splitting a hot join key is worth an extra exchange after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Adaptive execution joins small partitions, but never splits what one task of an
    # aggregation or window gets: many at the start, so that a task's share stays the same as tables grow.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    # What one task reads of a shuffle, compressed: rows of the ledger and of running totals take up to a
    # hundred times that while they are grouped and sorted.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Rows that lie together by a part of the join keys stay where they are.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Tables are written by date without sorting a task's rows, which lie together by date.
    "spark.sql.maxConcurrentOutputFileWriters": "64",
    # No call site per column expression: plans are built several times faster.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


# The same for the Python side; can only be set when a session is made.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def session(name: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session for the jobs; resources come from the cluster or `settings`."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **AT_START, **settings}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())
