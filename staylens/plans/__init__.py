"""Whole analyses, from captured pages to rankings and typed listings."""

from staylens.plans.listings import (
    all_listings,
    card_listings,
    list_listings,
    room_listings,
)
from staylens.plans.rankings import rankings, rankings_of_sources
from staylens.plans.requests import (
    listing_files,
    query_files,
    requests_from_captures,
    with_defaults,
)

__all__ = [
    "all_listings",
    "card_listings",
    "list_listings",
    "listing_files",
    "query_files",
    "rankings",
    "rankings_of_sources",
    "requests_from_captures",
    "room_listings",
    "with_defaults",
]
