"""Spark settings that suit this package's jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot sources and requests are split by the skew-join and rebalance rules.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Pages are large values: bound the rows and bytes one Arrow batch hands to Python.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.files.maxPartitionBytes": "128m",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; keys given in ``extra`` use ``__`` for a dot."""
    builder = SparkSession.builder.appName("staylens")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
