"""Arithmetic on vertex ids: contiguous ranges and fixed-size blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def integer_div(value: Column, divisor: int) -> Column:
    """Integer quotient, exact for every bigint (a plain ``/`` goes through double)."""
    return F.call_function("div", value.cast("bigint"), F.lit(divisor).cast("bigint"))


def range_of(vertex: Column, n_vertices: int, n_splits: int) -> Column:
    """Index of the near-equal contiguous range of ``[0, n_vertices)``; -1 outside.

    The first ``n_vertices % n_splits`` ranges hold one vertex more.
    """
    if n_vertices < 0 or n_splits < 1:
        raise ValueError("need n_vertices >= 0 and n_splits >= 1")
    size, spill = divmod(n_vertices, n_splits)
    wide = spill * (size + 1)
    in_narrow = integer_div(vertex - F.lit(wide), max(size, 1)) + F.lit(spill)
    return (
        F.when((vertex < 0) | (vertex >= n_vertices), F.lit(-1).cast("bigint"))
        .when(vertex < wide, integer_div(vertex, size + 1))
        .otherwise(in_narrow)
    )


def block_of(vertex: Column, block_size: int) -> Column:
    """Block of a vertex when blocks are ``block_size`` consecutive ids."""
    check_block_size(block_size)
    return integer_div(vertex - F.pmod(vertex, F.lit(block_size)), block_size)


def check_block_size(block_size: int) -> None:
    if block_size < 1:
        raise ValueError("block_size must be at least 1")


def has_bit(bitmap: Column, position: Column) -> Column:
    """Whether a bitmap (as ``bitmap_construct_agg`` builds them) has the bit; null for a null bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, integer_div(position, 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
