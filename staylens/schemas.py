"""Schemas of the tables this package reads and writes."""

from __future__ import annotations

CAPTURES = (
    "source string, request_id string, page_no int, captured_at timestamp, url string, html string"
)

REQUESTS = (
    "request_id string, source string, query string, check_in date, check_out date, "
    "adults int, children int"
)

LISTINGS = (
    "source string, request_id string, page_no int, item_pos int, room_pos int, "
    "name string, lodging_type string, location string, "
    "rating_raw string, rating10 decimal(5,1), "
    "price_raw string, price_krw bigint, price_basis string, "
    "room_type string, capacity string, capacity_n int, "
    "available boolean, link string"
)

RANKINGS = "source string, rank bigint, region string"

PLACES = "place_id string, name string, cuisine string, region string"

POSTS = "post_id string, region string, posted_at timestamp, title string, text string"

#: Columns that name one captured page.
CAPTURE_KEYS = ("source", "request_id", "page_no")
