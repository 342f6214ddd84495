"""Streams of binary cells: parsing is a projection, so it needs no state and no watermark."""

from .cells import parse_stream, read_layout_stream

__all__ = ["parse_stream", "read_layout_stream"]
