"""Keys that hold too many rows for one task."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjrank.session import DEFAULT_LIMITS, Limits, cut


class GroupSizes(NamedTuple):
    """Largest group of a table, the keys of groups too large for one task, or None, and further facts by name."""

    largest: int
    heavy: DataFrame | None
    facts: dict = {}


def group_sizes(
    df: DataFrame, key: str, limits: Limits = DEFAULT_LIMITS, total: int | None = None, facts: Sequence[Column] = ()
) -> GroupSizes:
    """Measure the groups of ``df``, one pass over the key.

    No pass is needed where the ``total`` number of rows is known and not too large for one group. The counts are
    pre-aggregated before their shuffle. At most ``limits.broadcast_rows`` keys can be heavy, see ``Limits.heavy_above``.
    ``facts`` are further aggregates of the groups (``key`` and its number of rows ``n``), taken in the same pass.
    """
    if total is not None and total <= limits.max_links and not facts:
        return GroupSizes(total, None)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = counts.agg(F.sum("n").alias("_total"), F.max("n").alias("_largest"), *facts).first().asDict()
    total, largest = found.pop("_total"), found.pop("_largest")
    if total is None:
        return GroupSizes(0, None, found)
    limit = limits.heavy_above(total)
    heavy = cut(counts.where(F.col("n") > limit).select(key)) if largest > limit else None
    return GroupSizes(largest, heavy, found)


def split_heavy(df: DataFrame, key: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and rows with a heavy key; neither side is shuffled."""
    heavy = F.broadcast(heavy)
    return df.join(heavy, key, "left_anti"), df.join(heavy, key, "left_semi")


def lookup(df: DataFrame, key: str, table: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """Left join with a table that has one row per key, safe for heavy keys.

    Rows with a heavy key stay where they are and meet a broadcast of just
    these keys' table rows; all others take an ordinary join.
    """
    if heavy is None:
        return df.join(table, key, "left")
    light_rows, heavy_rows = split_heavy(df, key, heavy)
    heavy_table = table.join(F.broadcast(heavy), key, "left_semi")
    return light_rows.join(table, key, "left").unionByName(
        heavy_rows.join(F.broadcast(heavy_table), key, "left")
    )
