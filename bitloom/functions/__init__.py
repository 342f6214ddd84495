"""Decoding and encoding of single cells, and expression values."""
