"""Column expressions used by the operators."""

from adjrank.functions.blocks import block_of, range_of
from adjrank.functions.parse import adjacency_line, parse_lines

__all__ = ["adjacency_line", "block_of", "parse_lines", "range_of"]
