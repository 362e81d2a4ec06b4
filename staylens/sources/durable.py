"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder, below ``spark.checkpoint.dir`` or else below the warehouse.

    On a cluster a warehouse on the machine's own disk is no shared folder, and is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/staylens-{spark.sparkContext.applicationId}"


def durable(frame: DataFrame, *partition_by: str) -> DataFrame:
    """The frame written to a Parquet table of its own and read back.

    Cuts the lineage where a result is needed twice and is costly to compute, or where it would
    not come out the same if a lost executor made Spark compute it again. As a table, unlike a
    checkpoint, it can be read column by column and its size is known to the optimizer.
    ``release`` removes it when it is no longer needed, ``clear_stored`` whatever is left.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    writer = frame.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    stored = spark.read.schema(frame.schema).parquet(path)
    stored.stored_at = path
    return stored


def release(*frames: DataFrame | None) -> None:
    """Deletes the tables behind frames that ``durable`` returned; others are left alone."""
    for frame in frames:
        path = getattr(frame, "stored_at", None)
        if path:
            _delete(frame.sparkSession, path)


def clear_stored(spark: SparkSession) -> None:
    """Deletes every table that this application has kept in the shared folder."""
    _delete(spark, shared_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
