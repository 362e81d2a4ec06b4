"""Listing and ranking files."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.operators.listings import listing_headers
from staylens.operators.newest import latest_rankings

BYTE_ORDER_MARK = "\ufeff"

#: Quoting of Python's csv module: quotes doubled, blanks kept, nothing for an empty text.
_CSV = {
    "header": "true",
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _marked(frame: DataFrame) -> DataFrame:
    """The frame with a byte order mark before its first header: the CSV writer adds none."""
    first = frame.columns[0]
    return frame.withColumnRenamed(first, BYTE_ORDER_MARK + first)


def write_listings(listings: DataFrame, path: str) -> None:
    """Typed listings as Parquet, one folder per source; folders of other sources stay."""
    rebalanced = listings.hint("rebalance", "source")
    rebalanced.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("source").parquet(path)


def write_listings_csv(
    listings: DataFrame,
    path: str,
    by: Sequence[str] = ("source", "query"),
    skip_empty: bool = True,
) -> None:
    """Listings as UTF-8 CSV with byte order mark and header, one folder per value of ``by``.

    The rebalance hint gathers the rows of a small query into one file and splits those of a
    hot one. Only the folders of the queries in ``listings`` are overwritten: files of other queries
    stay, and no rows overwrite nothing. With ``skip_empty=False`` the listings are those
    of one query: they go to ``path`` itself, with a header even if there are none. Lines end in
    LF: with CR LF the writer would also change line breaks inside a text.
    """
    body = [name for name in listings.columns if name not in by]
    if skip_empty:
        if not by and listings.isEmpty():
            return
        writer = _marked(listings.hint("rebalance", *by).select(*body, *by)).write.partitionBy(*by)
        writer = writer.option("partitionOverwriteMode", "dynamic") if by else writer
    else:
        writer = _marked(listings.hint("rebalance").select(*body)).write
    writer.mode("overwrite").options(**_CSV).csv(path)


def write_listing_files(files: DataFrame, path: str, queries: DataFrame | None = None) -> None:
    """One CSV file per query, with its platform's own columns and under its platform's own name.

    ``files`` has the columns of :func:`staylens.plans.listing_files`. Files lie in ``path`` itself, their
    rows in page order. A query with more rows than Spark puts into one task gives further files,
    ``name-2.csv`` and so on, in no order between them. A ``/`` in a name becomes ``_``. Files of the same
    name are replaced, others stay. Of the ``queries`` (see :func:`staylens.plans.query_files`) of a platform
    that writes a file without listings, those that have none get one with the header alone. Each
    platform is one job, written beside the target and moved there when it is complete, so readers
    never see half a file. Listings of other platforms have no file.
    """
    name = F.replace("file_name", F.lit("/"), F.lit("_")).alias("_file")
    for source in fv.LISTING_FILE_NAMES:
        headers = listing_headers(source)
        own = files.where(F.col("source") == source).select("*", name)
        rows = own.hint("rebalance", "_file").sortWithinPartitions("_file", "page_no", "item_pos", "room_pos")
        _publish(rows.select(*headers, "_file"), path)
        if queries is not None and source in fv.HEADER_ALWAYS:
            asked = queries.where(F.col("source") == source).select(name).distinct()
            _write_headers(asked.join(own.select("_file"), "_file", "left_anti"), headers, path)


def _publish(rows: DataFrame, path: str) -> None:
    """Writes rows as CSV by ``_file`` and moves the finished files to their names."""
    spark = rows.sparkSession
    staging = f"{path.rstrip('/')}/_staging_{uuid4().hex}"
    try:
        _marked(rows).write.partitionBy("_file").options(**_CSV).csv(staging)
        files, folder = _file_system(spark, path)
        for part in files.listStatus(_path(spark, staging)):
            name = part.getPath().getName()
            if not name.startswith("_file="):
                continue
            target = unquote(name.removeprefix("_file="))
            finished = sorted(f.getPath().toString() for f in files.listStatus(part.getPath()))
            for number, file in enumerate(finished, 1):
                stem, dot, ending = target.rpartition(".")
                numbered = target if number == 1 else f"{stem}-{number}{dot}{ending}"
                final = spark._jvm.org.apache.hadoop.fs.Path(folder, numbered)
                files.delete(final, False)
                if not files.rename(_path(spark, file), final):
                    raise OSError(f"cannot move a finished file to {final.toString()}")
    finally:
        files, _ = _file_system(spark, path)
        files.delete(_path(spark, staging), True)


def _write_headers(names: DataFrame, headers: Sequence[str], path: str) -> None:
    """A file with the header alone for each name; the names are read one partition at a time."""
    spark = names.sparkSession
    files, folder = _file_system(spark, path)
    head = bytearray(f"{BYTE_ORDER_MARK}{','.join(headers)}\n".encode())
    for row in names.toLocalIterator():
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(folder, row["_file"]), True)
        out.write(head)
        out.close()


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a folder, and the folder, which is made if need be."""
    folder = _path(spark, path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    return files, folder


def write_rankings_csv(
    rankings: DataFrame, path: str, at: str | None = None, others: str | None = None
) -> None:
    """One ranking per source as CSV, ordered by source and rank within and across the files.

    Where rankings have ``captured_at``, a source's ranking is that of its newest capture, not after
    the time ``at`` if given. ``others`` names a folder for the other captures, which get a file each:
    source, request, page and time in its name. Without ``captured_at`` all rows go to the file. The
    folder ``path`` is replaced, files in ``others`` only by those of the same capture.
    """
    chosen, rest = latest_rankings(rankings, at)
    headed = chosen.select(
        *[F.col(name).alias(header) for name, header in fv.RANKING_HEADERS.items()]
    )
    ordered = headed.repartitionByRange("Source", "Rank").sortWithinPartitions("Source", "Rank")
    _marked(ordered).write.mode("overwrite").options(**_CSV).csv(path)
    if others is not None and rest is not None:
        at_time = F.date_format("captured_at", "yyyyMMdd'T'HHmmss")
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "request_id", "page_no")]
        name = F.concat(F.concat_ws("_", *parts, at_time), F.lit(".csv"))
        named = rest.withColumn("_file", F.replace(name, F.lit("/"), F.lit("_")))
        rows = named.hint("rebalance", "_file").sortWithinPartitions("_file", "rank")
        headers = [F.col(c).alias(header) for c, header in fv.RANKING_HEADERS.items()]
        _publish(rows.select(*headers, "_file"), others)
