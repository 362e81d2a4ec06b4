"""Listings to rooms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens import fixed_values as fv
from staylens.functions.prices import (
    availability,
    no_rooms,
    price_basis,
    price_digits,
    price_first,
)
from staylens.functions.text import capacity, capacity_n, room_type


def explode_rooms(
    listings: DataFrame,
    rooms: str = "rooms",
    prices: str = "prices",
    status_texts: str = "status_texts",
) -> DataFrame:
    """One row per room of a listing whose rooms are an array; the listing's fields repeat.

    A room section without a description is no room, and a room without a price of its own has
    the listing's. A listing without rooms gets one default room. If a status text then says that
    it cannot be booked, its price text is the sold-out label even if a price was found;
    ``price_krw`` keeps the price found, and ``available`` does not take the word for "sale
    price" as sold out.
    """
    kept = [name for name in listings.columns if name not in (rooms, prices, status_texts)]
    described = F.filter(rooms, lambda room: room["description"].isNotNull())
    default_room = F.struct(*_default_room(availability("_rooms", status_texts)))
    array = F.when(no_rooms("_rooms"), F.array(default_room)).otherwise(
        F.transform("_rooms", lambda room: F.struct(*_room(room["description"], room["prices"])))
    )
    priced = listings.select(
        *kept, *_base_price(prices), status_texts, described.alias("_rooms")
    )
    return priced.select(
        *kept,
        availability("_rooms", status_texts, fv.SOLD_OUT_WORDS_STRICT).alias("available"),
        F.posexplode(array).alias("room_pos", "room"),
    ).select(*kept, "room_pos", "room.*", "available")


def _base_price(prices: str) -> list[Column]:
    """The listing's own price as text and as a number."""
    return [price_digits(prices).alias("_base_text"), price_first(prices).alias("_base_krw")]


def _room(description: Column, prices: Column) -> list[Column]:
    return [
        room_type(description).alias("room_type"),
        capacity(description).alias("capacity"),
        capacity_n(description).alias("capacity_n"),
        F.coalesce(price_digits(prices), "_base_text").alias("price_raw"),
        F.coalesce(price_first(prices), "_base_krw").alias("price_krw"),
        F.lit(fv.PER_NIGHT).alias("price_basis"),
    ]


def _default_room(bookable: Column) -> list[Column]:
    return [
        F.lit(fv.DEFAULT_ROOM).alias("room_type"),
        F.lit(fv.DEFAULT_CAPACITY).alias("capacity"),
        F.lit(None).cast("int").alias("capacity_n"),
        F.when(bookable, F.col("_base_text")).otherwise(fv.SOLD_OUT).alias("price_raw"),
        F.col("_base_krw").alias("price_krw"),
        price_basis(bookable).alias("price_basis"),
    ]


def attach_rooms(
    listings: DataFrame,
    rooms: DataFrame,
    on: str | Sequence[str],
    prices: str = "prices",
    status_texts: str = "status_texts",
) -> DataFrame:
    """Same result for rooms kept in a table, with a ``description`` and ``prices`` per room.

    Rooms are joined, not gathered, so a listing may have any number of them. Listings with and
    without rooms are two joins because a skewed inner join can be split on either side, an outer
    join only on the side it keeps.
    """
    keys = [on] if isinstance(on, str) else list(on)
    kept = [name for name in listings.columns if name not in (prices, status_texts)]
    extra = [name for name in rooms.columns if name not in (*keys, "description", "prices")]
    priced = listings.select(*kept, *_base_price(prices), status_texts)
    described = rooms.filter(F.col("description").isNotNull())
    with_rooms = priced.join(described, keys).select(
        *kept,
        *extra,
        *_room(F.col("description"), F.col("prices")),
        F.lit(True).alias("available"),
    )
    none = F.array().cast("array<string>")
    without = priced.join(described.select(*keys).distinct(), keys, "left_anti").select(
        *kept,
        *_default_room(availability(none, status_texts)),
        availability(none, status_texts, fv.SOLD_OUT_WORDS_STRICT).alias("available"),
    )
    return with_rooms.unionByName(without, allowMissingColumns=True)
