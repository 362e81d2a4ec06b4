"""The stateless part of the analyses on pages that keep arriving."""

from staylens.streaming.arrivals import stream_captures, stream_rooms, write_arrivals

__all__ = ["stream_captures", "stream_rooms", "write_arrivals"]
