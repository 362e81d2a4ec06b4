"""Typed listings of all platforms, and the view that looks like the platforms' own files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens import fixed_values as fv


def union_listings(*frames: DataFrame) -> DataFrame:
    """Listings of several platforms; columns a platform does not have are NULL."""
    return reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True), frames
    )


def _sentinel(field: str) -> Column:
    """The text a platform writes for a missing field, NULL if it has none for it."""
    texts = [(name, fields[field]) for name, fields in fv.SENTINELS.items() if field in fields]
    result = F.lit(None).cast("string")
    for name, text in texts:
        result = F.when(F.col("source") == name, text).otherwise(result)
    return result


def fill_sentinels(listings: DataFrame) -> DataFrame:
    """Listings with the texts the platforms' files hold in place of NULL."""
    filled = {
        field: F.coalesce(F.col(field), _sentinel(field))
        for field in fv.LISTING_HEADERS
        if field in listings.columns
    }
    return listings.withColumns(filled)


def listing_headers(source: str) -> list[str]:
    """Headers of a platform's file, in their order."""
    return [
        header for field, header in fv.LISTING_HEADERS.items() if field != "link" or source in fv.WITH_LINK
    ]


def compat_view(listings: DataFrame, link: bool = True) -> DataFrame:
    """Listings as strings under the files' headers, in their order, sentinels included.

    One platform's file has no link column: ``link=False``.
    """
    headers = {
        field: header for field, header in fv.LISTING_HEADERS.items() if link or field != "link"
    }
    return fill_sentinels(listings).select(
        *[F.col(field).cast("string").alias(header) for field, header in headers.items()]
    )
