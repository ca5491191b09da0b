"""Total order by rank and pairing of neighbours in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjrank.functions.blocks import integer_div
from adjrank.operators.convert import rank_vector
from adjrank.operators.position import global_index, rank_order


def sort_by_rank(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """``(id, rank)`` by descending rank, equal ranks by id.

    A range-partitioned sort; the id breaks ties, so that equal ranks spread
    over partitions. With ``limit`` only the first rows.
    """
    vector = ranked.select("id", "rank") if "id" in ranked.columns else rank_vector(ranked)
    ordered = vector.orderBy(*rank_order())
    return ordered if limit is None else ordered.limit(limit)


def pair_adjacent(ranked: DataFrame) -> DataFrame:
    """Pair 1st with 2nd, 3rd with 4th, … by descending rank as ``(pair_id, a, b)``.

    The last vertex of an odd number is paired with itself. A vector that has
    the places in a column ``pos`` (:func:`~adjrank.operators.load_positions`)
    is not sorted again.
    """
    if "pos" in ranked.columns:
        placed = ranked
    else:
        placed = global_index(ranked.select("id", "rank") if "id" in ranked.columns else rank_vector(ranked))
    # Neighbours mostly share a partition, so they combine before the shuffle.
    return (
        placed.groupBy(integer_div(F.col("pos"), 2).alias("pair_id"))
        .agg(F.min_by("id", "pos").alias("a"), F.max_by("id", "pos").alias("b"))
    )
