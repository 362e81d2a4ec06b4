"""Captured pages to the ranking table of all sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.operators.extract import extract_keywords
from staylens.operators.ranking import source_report, union_sources
from staylens.schemas import CAPTURE_KEYS
from staylens.sources.captures import probe, read_captures
from staylens.sources.durable import durable
from staylens.specs import ALL_KEYWORDS, KeywordSpec


def rankings(captures: DataFrame, specs: Sequence[KeywordSpec] = ALL_KEYWORDS) -> DataFrame:
    """Ranked keywords per source and captured page, with the time of the capture.

    A page's ranking is its array of keywords, so ranks come without a shuffle. Each source is
    read on its own, from its own folder if the table is partitioned by source.
    """
    keys = [*(name for name in CAPTURE_KEYS if name != "source"), "captured_at"]
    frames = {
        spec.source: extract_keywords(captures.filter(F.col("source") == spec.source), spec, keys)
        for spec in specs
    }
    return union_sources(frames).select(
        "source", *keys, (F.col("pos") + 1).cast("bigint").alias("rank"), "region"
    )


def rankings_of_sources(
    spark: SparkSession, paths: Mapping[str, str], specs: Sequence[KeywordSpec] = ALL_KEYWORDS
) -> tuple[DataFrame, DataFrame]:
    """Rankings of captures that lie at a path for each source, and a report per source.

    Each source is a job of its own whose rankings are stored, so whatever fails while one is read
    (a missing path, a broken file, damage inside it) leaves the others standing. Such a source adds
    no rows and is reported as ``missing`` or ``failed``. A failure of the cluster counts as one of
    the source that was being read.
    """
    frames, status = {}, {}
    for spec in specs:
        if spec.source not in paths:
            continue
        path = paths[spec.source]
        status[spec.source] = probe(spark, path)
        if status[spec.source] != "ok":
            continue
        try:
            captures = read_captures(spark, path).withColumn("source", F.lit(spec.source))
            frames[spec.source] = durable(rankings(captures, [spec]))
        except (PySparkException, Py4JError):
            status[spec.source] = "failed"
    if frames:
        ranked = union_sources(frames)
    else:
        keys = "source string, request_id string, page_no int, captured_at timestamp"
        ranked = spark.createDataFrame([], f"{keys}, rank bigint, region string")
    return ranked, source_report(ranked, paths, status)
