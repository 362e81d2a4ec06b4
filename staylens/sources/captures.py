"""Tables of captured pages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from staylens import schemas
from staylens.sources.durable import durable

#: Superseded captures that are broadcast at most, as bytes; beyond, Spark joins as it sees fit.
SUPERSEDED_BYTES = 64 << 20
#: What one of them takes: a hash of its file's name and a place in the file, with the table's overhead.
_SUPERSEDED_ROW = 64


def read_captures(
    spark: SparkSession,
    path: str,
    sources: Iterable[str] | None = None,
    request_ids: Iterable[str] | None = None,
) -> DataFrame:
    """Captured pages of a Parquet table, best written with ``partitionBy("source")``.

    The filters reach the scan: one prunes folders, the other row groups.
    """
    captures = spark.read.schema(schemas.CAPTURES).parquet(path)
    if sources is not None:
        captures = captures.filter(F.col("source").isin(list(sources)))
    if request_ids is not None:
        captures = captures.filter(F.col("request_id").isin(list(request_ids)))
    return captures


def read_newest_captures(
    spark: SparkSession,
    path: str,
    sources: Iterable[str] | None = None,
    request_ids: Iterable[str] | None = None,
    keys: Sequence[str] = schemas.CAPTURE_KEYS,
) -> DataFrame:
    """Captured pages, of each page the newest capture alone.

    Of captures with the same time one counts, those without a time are the oldest. First the keys,
    the times and the rows' places in their files are read, and the places of captures that a newer
    one supersedes are kept in a table; then the pages are read without those. While the places fit
    into ``SUPERSEDED_BYTES`` they are broadcast, so pages are not shuffled; more than that are left to a
    join of tables.
    """
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    captures = read_captures(spark, path, sources, request_ids)
    placed = captures.select(*keys, "captured_at", *place)
    newest = placed.groupBy(*keys).agg(
        F.max(F.struct("captured_at", "_file", "_row")).alias("_newest"), F.count("*").alias("_n")
    ).where("_n > 1")
    of_page = [F.col(f"p.{key}").eqNullSafe(F.col(f"n.{key}")) for key in keys]
    older = (F.col("_newest._file") != F.col("p._file")) | (F.col("_newest._row") != F.col("p._row"))
    superseded = durable(
        placed.alias("p").join(newest.alias("n"), of_page).where(older).select("p._file", "p._row")
    )
    if superseded.count() * _SUPERSEDED_ROW <= SUPERSEDED_BYTES:
        superseded = F.broadcast(superseded)
    return captures.select("*", *place).join(superseded, ["_file", "_row"], "left_anti").drop("_file", "_row")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Search requests of a Parquet table."""
    return spark.read.schema(schemas.REQUESTS).parquet(path)


def read_sources(
    spark: SparkSession, paths: Mapping[str, str]
) -> tuple[DataFrame, dict[str, str]]:
    """Captures of several sources, each at its own path, and a status per source.

    A source whose path does not exist has the status ``missing``, one with a file that is no
    Parquet or holds a column of another type ``failed``; both add no rows, and the others are read all
    the same. The footers of all files are read for that. Damage inside a file shows only when its
    pages are read; :func:`staylens.plans.rankings_of_sources` stands that as well.
    """
    frames, status = [], {}
    for source, path in paths.items():
        status[source] = probe(spark, path)
        if status[source] == "ok":
            frames.append(read_captures(spark, path).withColumn("source", F.lit(source)))
    captures = spark.createDataFrame([], schemas.CAPTURES)
    for frame in frames:
        captures = captures.unionByName(frame)
    return captures, status


def probe(spark: SparkSession, path: str) -> str:
    """``ok``, ``missing`` or ``failed``: whether every file of a table of captures can be opened and read."""
    wanted = {field.name: field.dataType for field in StructType.fromDDL(schemas.CAPTURES)}
    try:
        stored = spark.read.option("mergeSchema", "true").parquet(path)
        found = {field.name: field.dataType for field in stored.schema if field.name in wanted}
        if "html" not in found or any(kind != wanted[name] for name, kind in found.items() if name != "source"):
            return "failed"
        read_captures(spark, path).agg(F.count("*")).collect()
    except AnalysisException as error:
        return "missing" if error.getCondition() == "PATH_NOT_FOUND" else "failed"
    except (PySparkException, Py4JError):
        return "failed"
    return "ok"
