"""The newest capture of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_rankings(rankings: DataFrame, at: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rankings of each source's newest capture (not after ``at``), and those of its other captures.

    A capture is a time, a request and a page; of equal times the last request and page count. The
    newest is found from one row per source, so nothing else is shuffled where that is small.
    Rankings without ``captured_at`` are returned whole, with None for the others.
    """
    if "captured_at" not in rankings.columns:
        return rankings, None
    capture = F.struct("captured_at", "request_id", "page_no")
    in_time = rankings if at is None else rankings.where(F.col("captured_at") <= F.lit(at).cast("timestamp"))
    newest = in_time.groupBy(F.col("source").alias("_source")).agg(F.max(capture).alias("_capture"))
    joined = rankings.join(newest, F.col("source").eqNullSafe(F.col("_source")), "left")
    is_newest = capture.eqNullSafe(F.col("_capture"))
    return tuple(joined.where(c).select(rankings.columns) for c in (is_newest, ~is_newest))
