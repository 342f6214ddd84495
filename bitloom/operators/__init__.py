"""Parsing and producing columns of binary cells."""

from .cells import decode_column, encode_column, explain, nodes, parse, produce, records, register, register_records, size_column

__all__ = ["decode_column", "encode_column", "explain", "nodes", "parse", "produce", "records", "register", "register_records", "size_column"]
