"""Search requests: defaults, requests read back from captured pages, listings per request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.functions.addresses import output_key, request_from_url
from staylens.operators.listings import fill_sentinels


def with_defaults(requests: DataFrame) -> DataFrame:
    """Requests with the guests a search has if none are given."""
    defaults = {"adults": fv.DEFAULT_ADULTS, "children": fv.DEFAULT_CHILDREN}
    return requests.withColumns(
        {name: F.coalesce(name, F.lit(value)) for name, value in defaults.items()}
    )


def requests_from_captures(captures: DataFrame) -> DataFrame:
    """Requests of pages whose address holds them, one row per request.

    Where the pages of a request differ, its first page counts (of equal ones the first address).
    """
    found = captures.select(
        "request_id", "source", "page_no", "url", request_from_url("url").alias("request")
    ).filter(F.col("request.query").isNotNull())
    first = F.min_by("request", F.struct("page_no", "url")).alias("request")
    stated = found.groupBy("request_id", "source").agg(first).select(
        "request_id", "source", "request.query", "request.check_in", "request.check_out",
        "request.adults",
    )
    return with_defaults(stated.withColumn("children", F.lit(None).cast("int")))


def query_files(requests: DataFrame) -> DataFrame:
    """``request_id``, ``source``, ``query`` and ``file_name``: the file that each request's listings go to.

    Requests without a query are named by their ``request_id``.
    """
    name = output_key(F.coalesce("query", "request_id"), "source")
    return requests.select("request_id", "source", "query", name.alias("file_name"))


def listing_files(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """Listings as the platforms' files hold them, with source, query, place and name of their file.

    Made for :func:`staylens.sources.write_listing_files`, which writes each platform's own columns.
    Listings without a known request have a NULL query and a file named by their ``request_id``.
    Requests are one row per request, so a hot request can be split in the join.
    """
    joined = fill_sentinels(listings).join(query_files(requests), ["request_id", "source"], "left")
    return joined.select(
        "source",
        "query",
        F.coalesce("file_name", output_key("request_id", "source")).alias("file_name"),
        "page_no",
        "item_pos",
        "room_pos",
        *[F.col(field).alias(header) for field, header in fv.LISTING_HEADERS.items()],
    )
