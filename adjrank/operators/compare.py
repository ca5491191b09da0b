"""Comparison of rank vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rank_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(id, delta)``: absolute difference, or the rank itself for an id of one side.

    Ids have to be unique in each vector. A union and one hash aggregation
    instead of a full outer join: the same shuffle, and nothing is sorted.
    """
    nothing = F.lit(None).cast("double")
    both = a.select("id", F.col("rank").alias("left"), nothing.alias("right")).unionAll(
        b.select("id", nothing, F.col("rank"))
    )
    left, right = F.max("left"), F.max("right")
    return both.groupBy("id").agg(F.coalesce(F.abs(left - right), left, right).alias("delta"))


def max_rank_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``max_delta``; 0.0 for equal vectors, NULL for two empty ones."""
    return rank_deltas(a, b).agg(F.max("delta").alias("max_delta"))


def unconverged_count(old: DataFrame, new: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row ``unconverged``: ids of ``new`` whose rank moved by more than ``threshold``.

    An id missing from ``old`` had rank 0. Without a threshold every id counts.
    """
    if threshold is None:
        return new.agg(F.count(F.lit(1)).alias("unconverged"))
    before = old.select("id", F.col("rank").alias("before"))
    moved = F.abs(F.col("rank") - F.coalesce("before", F.lit(0.0))) > F.lit(max(float(threshold), 0.0))
    return new.join(before, "id", "left").agg(F.count_if(moved).alias("unconverged"))
