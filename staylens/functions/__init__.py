"""Column functions: text, prices, ratings, dates, addresses and markup."""

from staylens.functions.addresses import absolute_url, output_key, request_from_url, search_url
from staylens.functions.dates import korean_date, months_ahead, nights, price_per_night, stay_date
from staylens.functions.prices import (
    availability,
    price_basis,
    price_digits,
    price_first,
    price_joined,
    price_krw,
    price_won,
)
from staylens.functions.ratings import rating10, rating_x2
from staylens.functions.text import (
    capacity,
    capacity_n,
    contains_any,
    has_match_key,
    int_or,
    join_spans,
    match_key,
    room_type,
    strip,
)

__all__ = [
    "absolute_url",
    "availability",
    "capacity",
    "capacity_n",
    "contains_any",
    "has_match_key",
    "int_or",
    "join_spans",
    "korean_date",
    "match_key",
    "months_ahead",
    "nights",
    "output_key",
    "price_basis",
    "price_digits",
    "price_first",
    "price_joined",
    "price_krw",
    "price_per_night",
    "price_won",
    "rating10",
    "rating_x2",
    "request_from_url",
    "room_type",
    "search_url",
    "stay_date",
    "strip",
]
