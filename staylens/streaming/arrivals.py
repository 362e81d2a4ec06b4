"""Captured pages as a stream of files.

Extraction and cleaning look at one page at a time, so the same functions work on a streaming
frame. Where a request ends is known only when it has been captured as a whole: the platforms
read page by page are therefore cut in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from staylens import schemas
from staylens.plans.listings import room_listings


def stream_captures(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Captured pages as they arrive in a folder of Parquet files."""
    reader = spark.readStream.schema(schemas.CAPTURES)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_rooms(captures: DataFrame) -> DataFrame:
    """Typed listings, one row per room, of arriving pages."""
    return room_listings(captures)


def write_arrivals(listings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends listings to a Parquet table, once for everything that has arrived."""
    writer = listings.writeStream.format("parquet").partitionBy("source")
    return (
        writer.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start(path)
    )
