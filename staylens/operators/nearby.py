"""Restaurants near lodgings and festival posts of a region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.functions.text import as_column, match_key


def _in_cuisines(places: DataFrame, cuisines: Sequence[str]) -> DataFrame:
    return places.filter(F.col("cuisine").isin(list(cuisines))).withColumn(
        "region_key", match_key("region")
    )


def near_restaurants(
    listings: DataFrame,
    places: DataFrame,
    cuisines: Sequence[str] = fv.CUISINES,
    lodging: str | None = None,
) -> DataFrame:
    """Restaurants of the given cuisines in the regions of the listings, or of one lodging.

    Near means the same region. Each region of the listings is one row before the join, so a
    restaurant comes out once, with the number of lodgings it is near to, never once per lodging.
    """
    if lodging is not None:
        listings = listings.filter(match_key("name") == match_key(F.lit(lodging)))
    regions = (
        listings.select(match_key("location").alias("region_key"), "name")
        .distinct()
        .groupBy("region_key")
        .agg(F.count("*").alias("n_lodgings"))
    )
    return _in_cuisines(places, cuisines).join(regions, "region_key").drop("region_key")


def near_cuisine_counts(
    listings: DataFrame, places: DataFrame, cuisines: Sequence[str] = fv.CUISINES
) -> DataFrame:
    """Listings with the number of restaurants near them, one column per cuisine.

    Restaurants are counted per region before the join.
    """
    counted = (
        _in_cuisines(places, cuisines)
        .groupBy("region_key")
        .agg(*[F.count_if(F.col("cuisine") == name).alias(f"near_{name}") for name in cuisines])
    )
    keyed = listings.withColumn("region_key", match_key("location"))
    near = [F.coalesce(f"near_{name}", F.lit(0)).alias(f"near_{name}") for name in cuisines]
    return keyed.join(counted, "region_key", "left").select(*listings.columns, *near)


def _is_festival(text: Column | str, posted_at: Column | str, year: int, word: str) -> Column:
    # A range of texts, which take the type of the timestamp column: the scan can use it.
    start, end = (F.lit(f"{first}-01-01 00:00:00") for first in (year, year + 1))
    posted = as_column(posted_at)
    return as_column(text).contains(word) & (posted >= start) & (posted < end)


def festival_posts(
    posts: DataFrame,
    region: str | None = None,
    year: int = fv.FESTIVAL_YEAR,
    word: str = fv.FESTIVAL_WORD,
) -> DataFrame:
    """Festival posts of a year with the day they were posted, of one region or of all."""
    kept = posts.filter(_is_festival("text", "posted_at", year, word))
    if region is not None:
        kept = kept.filter(match_key("region") == match_key(F.lit(region)))
    return kept.withColumn("posted_on", F.to_date("posted_at"))


def festival_by_date(
    posts: DataFrame,
    region: str | None = None,
    year: int = fv.FESTIVAL_YEAR,
    word: str = fv.FESTIVAL_WORD,
) -> DataFrame:
    """Number of festival posts per region and day, with the first and last of the day.

    The posts of a day are rows of :func:`festival_posts`, not gathered into one value: a day
    may have any number of them.
    """
    return (
        festival_posts(posts, region, year, word)
        .groupBy("region", "posted_on")
        .agg(
            F.count("*").alias("n"),
            F.min("posted_at").alias("first_at"),
            F.max("posted_at").alias("last_at"),
        )
    )
