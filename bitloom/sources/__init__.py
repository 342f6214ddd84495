"""Bundled layouts, and binary files as tables."""

from .files import read_layout, write_cells
from .formats import FORMATS, layout_of

__all__ = ["FORMATS", "layout_of", "read_layout", "write_cells"]
