"""Prices and ratings across platforms, and value for money."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.functions.dates import nights, price_per_night
from staylens.functions.text import has_match_key, match_key
from staylens.operators.ranking import rank_by_order


def comparable(listings: DataFrame) -> DataFrame:
    """Listings that have a price and are not known to be sold out."""
    return listings.filter(
        F.col("price_krw").isNotNull() & F.coalesce(F.col("available"), F.lit(True))
    )


def compare_platforms(
    listings: DataFrame, keys: Sequence[str] = ("location", "source")
) -> DataFrame:
    """Per region and platform: count, lowest, mean and exact median price, mean rating.

    ``mixed_basis`` marks groups whose prices do not all cover the same thing.

    Rows are first reduced to one per price, with a partial aggregate, so a region may hold any
    number of listings. What is then ordered per region is its different prices in whole won.
    """
    prices = (
        comparable(listings)
        .groupBy(*keys, "price_krw")
        .agg(
            F.count("*").alias("n"),
            F.sum("rating10").alias("rating_sum"),
            F.count("rating10").alias("rating_n"),
            _per_night().alias("n_per_night"),
        )
    )
    group = W.partitionBy(*keys)
    running = group.orderBy("price_krw").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto, total = F.col("_upto"), F.col("_total")
    low, high = F.floor((total + 1) / 2), F.floor((total + 2) / 2)

    def holds(place: Column) -> Column:
        return (upto >= place) & (upto - F.col("n") < place)

    placed = prices.withColumns(
        {"_upto": F.sum("n").over(running), "_total": F.sum("n").over(group)}
    )
    at_low = F.max(F.when(holds(low), F.col("price_krw")))
    at_high = F.max(F.when(holds(high), F.col("price_krw")))
    n = F.sum("n")
    return placed.groupBy(*keys).agg(
        n.alias("n"),
        F.min("price_krw").alias("min_price"),
        (F.sum(F.col("price_krw") * F.col("n")).cast("double") / n).alias("avg_price"),
        ((at_low + at_high).cast("double") / 2).alias("median_price"),
        (
            F.sum("rating_sum").cast("double") / F.nullif(F.sum("rating_n"), F.lit(0))
        ).alias("avg_rating"),
        _mixed(F.sum("n_per_night"), n).alias("mixed_basis"),
    )


def _per_night() -> Column:
    """Rows priced for one night. A count, as the least and greatest text would need a sort."""
    return F.count_if(F.col("price_basis") == fv.PER_NIGHT)


def _mixed(n_per_night: Column, n: Column) -> Column:
    return (n_per_night > 0) & (n_per_night < n)


def _matchable(listings: DataFrame) -> DataFrame:
    """Comparable listings with a name and a region to match by; the others match nothing.

    Filtering by the keys themselves would compute them twice, once in the filter.
    """
    return comparable(listings).filter(has_match_key("name") & has_match_key("location"))


def _keyed(listings: DataFrame) -> DataFrame:
    return listings.withColumns(
        {"match_key": match_key("name"), "region_key": match_key("location")}
    )


def _spelling() -> Column:
    """First of a group's spellings of its region. A set of the few there are hashes; a least text would sort."""
    return F.array_min(F.collect_set("location"))


#: Columns that two offers must share to be for the same stay.
STAY = ("check_in", "check_out")


def with_stays(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """Listings with ``check_in``, ``check_out``, ``nights`` and ``per_night`` of the request they answer.

    ``per_night`` is the price itself where that is for one night, else the price of the stay by its
    nights; NULL where the stay is unknown or invalid. Requests are one row per request, so a hot
    request's listings can be split in the join.
    """
    stays = requests.select("request_id", "source", *STAY)
    joined = listings.join(stays, ["request_id", "source"], "left")
    known = nights("check_in", "check_out")
    of_one = F.when(known.isNotNull(), F.col("price_krw").cast("double"))
    per_night = F.when(F.col("price_basis") == fv.PER_NIGHT, of_one).otherwise(
        price_per_night("price_krw", "check_in", "check_out")
    )
    return joined.withColumns({"nights": known, "per_night": per_night})


def per_night_gap(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """Price gaps per night between platforms, of the same lodging for the same stay.

    Offers without a valid stay compare with nothing. The columns of :func:`price_gap`, and the stay;
    prices and gaps are per night.
    """
    stays = with_stays(comparable(listings), requests).filter(F.col("per_night").isNotNull())
    return price_gap(stays, stay=(*STAY, "nights"), price="per_night")


def match_lodgings(
    listings: DataFrame, stay: Sequence[str] = (), price: str = "price_krw"
) -> DataFrame:
    """Lowest price per lodging and platform, for lodgings matched by name and region.

    Names and regions are compared without case, blanks and punctuation; ``location`` is the first
    of a lodging's spellings. Listings whose name or region is missing or only punctuation match
    nothing. ``stay`` names further columns that must be equal, such as the dates, and ``price`` the
    column whose lowest value counts. ``n_per_night``
    of the ``n`` offers are known to be priced for one night. Keys are computed once per spelling,
    from what each task has aggregated, not once per listing.
    """
    spelled = _matchable(listings).groupBy("name", "location", *stay, "source").agg(
        F.min(price).alias(price), F.count("*").alias("n"), _per_night().alias("n_per_night")
    )
    return _keyed(spelled).groupBy("match_key", "region_key", *stay, "source").agg(
        _spelling().alias("location"),
        F.min(price).alias(price),
        F.sum("n").alias("n"),
        F.sum("n_per_night").alias("n_per_night"),
    )


def price_gap(
    listings: DataFrame, stay: Sequence[str] = (), price: str = "price_krw"
) -> DataFrame:
    """Per lodging and platform: lowest price, cheapest platform, and the gap to it.

    ``stay`` and ``price`` as in :func:`match_lodgings`; lodgings are then compared per stay.

    The window runs over matched lodgings, which have one row per platform. Of platforms at the
    same price the first by name counts as cheapest. ``mixed_basis`` marks lodgings whose prices
    do not all cover the same thing.
    """
    lodging = W.partitionBy("match_key", "region_key", *stay)
    matched = match_lodgings(listings, stay, price)
    cheapest = F.min(F.struct(price, "source")).over(lodging)
    return matched.select(
        "match_key",
        *stay,
        F.min("location").over(lodging).alias("location"),
        "source",
        price,
        cheapest["source"].alias("cheapest_source"),
        (F.col(price) - cheapest[price]).alias("gap"),
        F.count("*").over(lodging).alias("n_platforms"),
        _mixed(F.sum("n_per_night").over(lodging), F.sum("n").over(lodging)).alias("mixed_basis"),
    )


def pivot_prices(
    listings: DataFrame,
    platforms: Sequence[str],
    stay: Sequence[str] = (),
    price: str = "price_krw",
) -> DataFrame:
    """One row per lodging (and ``stay``), one column with the lowest price per platform.

    Naming the platforms spares the extra job that finds them.
    """
    lowest = [
        F.min(F.when(F.col("source") == name, F.col(price))).alias(name) for name in platforms
    ]
    mixed = _mixed(_per_night(), F.count("*"))
    grouped = _keyed(_matchable(listings)).groupBy("match_key", "region_key", *stay)
    return grouped.agg(_spelling().alias("location"), *lowest, mixed.alias("mixed_basis")).drop(
        "region_key"
    )


def value_score(
    rating: Column | str = "rating10", price: Column | str = "price_krw"
) -> Column:
    """Rating points per 10,000 won; NULL without a rating or a positive price."""
    rating = F.col(rating) if isinstance(rating, str) else rating
    price = F.col(price) if isinstance(price, str) else price
    return F.when(price > 0, rating.cast("double") / (price.cast("double") / F.lit(10000.0)))


def value_order(ties: Sequence[str] = ()) -> list[Column]:
    """Best value first, then cheaper, better rated, by name and platform, then ``ties``."""
    return [
        F.col("value_score").desc_nulls_last(),
        F.col("price_krw").asc_nulls_last(),
        F.col("rating10").desc_nulls_last(),
        F.col("name").asc_nulls_last(),
        F.col("source").asc_nulls_last(),
        *[F.col(name).asc_nulls_last() for name in ties],
    ]


def value_rank(
    listings: DataFrame, per: Sequence[str] = (), ties: Sequence[str] = ()
) -> DataFrame:
    """All listings ranked by value for money, over everything or within ``per``.

    No two listings share a rank. ``ties`` names further columns, such as an item's position,
    that decide between listings equal in everything else.
    """
    scored = listings.withColumn("value_score", value_score())
    return rank_by_order(scored, list(per), value_order(ties), rank="value_rank")


def top_value(
    listings: DataFrame, k: int, per: Sequence[str] = ("location",), ties: Sequence[str] = ()
) -> DataFrame:
    """The k best listings by value within ``per``.

    Catalyst limits every task to k rows per group before the shuffle.
    """
    scored = listings.withColumn("value_score", value_score())
    best = W.partitionBy(*per).orderBy(*value_order(ties))
    return scored.withColumn("value_rank", F.row_number().over(best)).filter(
        F.col("value_rank") <= k
    )
