"""Captured pages in, listing and ranking files out."""

from staylens.sources.captures import (
    probe,
    read_captures,
    read_newest_captures,
    read_requests,
    read_sources,
)
from staylens.sources.durable import clear_stored, durable, release, shared_folder
from staylens.sources.sinks import (
    write_listing_files,
    write_listings,
    write_listings_csv,
    write_rankings_csv,
)

__all__ = [
    "clear_stored",
    "durable",
    "probe",
    "read_captures",
    "read_newest_captures",
    "read_requests",
    "read_sources",
    "release",
    "shared_folder",
    "write_listing_files",
    "write_listings",
    "write_listings_csv",
    "write_rankings_csv",
]
