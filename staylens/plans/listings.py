"""Captured pages to typed listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from staylens import fixed_values as fv
from staylens import schemas
from staylens.functions.addresses import absolute_url
from staylens.functions.prices import price_joined, price_krw, price_won
from staylens.functions.ratings import rating10, rating_x2
from staylens.functions.text import join_spans, strip
from staylens.operators.extract import (
    card_pages,
    explode_lists,
    extract_cards,
    list_pages,
    page_prefix,
    stored_errors,
)
from staylens.operators.listings import union_listings
from staylens.operators.rooms import explode_rooms
from staylens.sources.durable import durable
from staylens.specs import (
    TRIVAGO_CARDS,
    YANOLJA_CARDS,
    YEOGI_LISTS,
    YEOGI_LISTS_LEAF,
    CardSpec,
    ListSpec,
)

_KEYS = list(schemas.CAPTURE_KEYS)


def _typed(listings: DataFrame) -> DataFrame:
    """The listing schema: its columns in order, cast, NULL where a platform has none."""
    schema = StructType.fromDDL(schemas.LISTINGS)
    present = set(listings.columns)
    return listings.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def _of(captures: DataFrame, source: str) -> DataFrame:
    return captures.filter(F.col("source") == source)


def card_items(captures: DataFrame, spec: CardSpec = TRIVAGO_CARDS) -> DataFrame:
    """Cards of the pages up to the end of each request, one row per card."""
    return card_items_and_errors(captures, spec)[0]


def card_items_and_errors(
    captures: DataFrame, spec: CardSpec = TRIVAGO_CARDS
) -> tuple[DataFrame, DataFrame]:
    """The cards, and the pages that could not be read with the reader's words, from one reading.

    Pages are parsed once into a durable table: the end of a request is found from its small
    columns, and the cards and the errors are read from it afterwards.
    """
    pages = durable(card_pages(_of(captures, spec.source), spec))
    kept = page_prefix(pages, ["source", "request_id"], is_last="is_last")
    cards = kept.select(*_KEYS, F.posexplode("items").alias("item_pos", "item")).select(
        *_KEYS, "item_pos", "item.*"
    )
    return cards, stored_errors(pages)


def list_items(captures: DataFrame, spec: ListSpec = YEOGI_LISTS) -> DataFrame:
    """Listings read by position, of the pages before the first empty one of each request."""
    return list_items_and_errors(captures, spec)[0]


def list_items_and_errors(
    captures: DataFrame, spec: ListSpec = YEOGI_LISTS
) -> tuple[DataFrame, DataFrame]:
    """The listings, and the pages that could not be read, from one reading into a durable table."""
    pages = durable(list_pages(_of(captures, spec.source), spec))
    return explode_lists(page_prefix(pages, ["source", "request_id"])), stored_errors(pages)


def card_listings(captures: DataFrame, keep_incomplete: bool = False) -> DataFrame:
    """Listings of the card platform. ``keep_incomplete`` keeps cards that lack a field."""
    spec = TRIVAGO_CARDS
    if keep_incomplete:
        spec = CardSpec(spec.source, spec.card, spec.fields, (), spec.next_page)
    cards = card_items(captures, spec)
    return _typed(
        cards.select(
            *_KEYS,
            "item_pos",
            "name",
            "lodging_type",
            "location",
            F.col("rating").alias("rating_raw"),
            rating10("rating", "source").alias("rating10"),
            price_won("price").alias("price_raw"),
            price_krw("price").alias("price_krw"),
        )
    )


def room_listings(captures: DataFrame) -> DataFrame:
    """Listings of the platform with rooms, one row per room."""
    cards = extract_cards(_of(captures, YANOLJA_CARDS.source), YANOLJA_CARDS)
    listings = cards.select(
        *_KEYS,
        "item_pos",
        "name",
        "lodging_type",
        "location",
        rating_x2("rating").alias("rating_raw"),
        rating10("rating", "source").alias("rating10"),
        F.nullif("link", F.lit("")).alias("link"),
        "prices",
        "rooms",
        "status_texts",
    )
    return _typed(explode_rooms(listings))


def list_listings(captures: DataFrame, leaf_spans: bool = False) -> DataFrame:
    """Listings of the platform read by position.

    ``leaf_spans`` leaves out spans that hold other spans, whose text would come twice.
    """
    items = list_items(captures, YEOGI_LISTS_LEAF if leaf_spans else YEOGI_LISTS)
    price = price_joined("price.spans")
    return _typed(
        items.select(
            *_KEYS,
            "item_pos",
            strip("name").alias("name"),
            "lodging_type",
            join_spans("location.spans").alias("location"),
            F.col("rating").alias("rating_raw"),
            rating10("rating", "source").alias("rating10"),
            price.alias("price_raw"),
            price_krw(price).alias("price_krw"),
            F.when(price.contains(fv.PER_NIGHT_SUFFIX), fv.PER_NIGHT).alias("price_basis"),
            absolute_url(fv.YEOGI_HOST, "link").alias("link"),
        )
    )


def all_listings(captures: DataFrame) -> DataFrame:
    """Typed listings of all three platforms."""
    return union_listings(
        card_listings(captures), room_listings(captures), list_listings(captures)
    )
