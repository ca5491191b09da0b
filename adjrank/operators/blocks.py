"""Vertex ranges, blocks of consecutive rows, and local edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjrank.functions.blocks import block_of, check_block_size, has_bit, integer_div
from adjrank.operators.placement import spread_evenly
from adjrank.operators.position import global_index
from adjrank.operators.skew import group_sizes, lookup
from adjrank.session import DEFAULT_LIMITS, Limits, cut, shuffle_partitions

BY = ("range", "position")
# Bitmaps of 4 KB each that are broadcast at most.
MOST_BITMAPS = 16_384


def vertex_ranges(spark: SparkSession, n_vertices: int, n_splits: int) -> DataFrame:
    """``(split, first, last)``: near-equal contiguous ranges of ``[0, n_vertices)``.

    The first ``n_vertices % n_splits`` ranges hold one vertex more. With more
    splits than vertices the trailing ranges are empty, ``last = first - 1``.
    """
    if n_vertices < 0 or n_splits < 1:
        raise ValueError("need n_vertices >= 0 and n_splits >= 1")
    size, spill = divmod(n_vertices, n_splits)

    def begin(split):
        return split * size + F.least(split, F.lit(spill))

    split = F.col("split")
    return (
        spark.range(n_splits)
        .select(F.col("id").alias("split"))
        .select("split", begin(split).alias("first"), (begin(split + 1) - 1).alias("last"))
    )


def assign_blocks(
    adj: DataFrame, block_size: int, by: str = "range", co_locate: bool = False
) -> DataFrame:
    """Add ``block_id``: groups of at most ``block_size`` consecutive vertices.

    ``by='range'`` cuts the id range, ``by='position'`` the vertices that have
    a row, in id order. ``co_locate`` also brings a block's rows together:
    blocks are dealt to partitions by their number of links, the largest first,
    and go there directly, so that partitions are as even as blocks allow.
    """
    check_block_size(block_size)
    if by not in BY:
        raise ValueError(f"by must be one of {', '.join(BY)}")
    if by == "range":
        blocked = adj.withColumn("block_id", block_of(F.col("src"), block_size))
    else:
        # only the ids are put in order
        blocked = adj.join(_positions(adj.select("src").distinct(), block_size), "src")
    if not co_locate:
        return blocked
    partitions = shuffle_partitions(adj.sparkSession)
    sizes = blocked.groupBy("block_id").agg(F.sum(F.size("dst") + 1).alias("weight"))
    placed = spread_evenly(sizes, "block_id", "weight", partitions)
    columns = [F.col(name) for name in blocked.columns]
    return blocked.join(placed, "block_id").repartitionById(partitions, F.col("partition")).select(*columns)


def _positions(rows: DataFrame, block_size: int) -> DataFrame:
    placed = global_index(rows, [F.asc("src")])
    return placed.withColumn("block_id", integer_div(F.col("pos"), block_size)).drop("pos")


def block_bounds(ids: DataFrame, block_size: int) -> DataFrame:
    """``(id, low, high)``: the id interval of every vertex's block, by position.

    Blocks are consecutive in id order, so "in my block" is an interval test
    and needs no join of the edges.
    """
    blocks = _positions(ids.select(F.col("id").alias("src")), block_size)
    spans = blocks.groupBy("block_id").agg(F.min("src").alias("low"), F.max("src").alias("high"))
    return blocks.join(spans, "block_id").select(F.col("src").alias("id"), "low", "high")


def classify_edges(edges: DataFrame, blocks: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Add ``is_local``: the destination has a row in the source's block.

    ``blocks`` holds ``src`` and ``block_id`` of every vertex with a row. A
    destination without a row is external, whatever its id.

    Edges are shuffled once, to the block of their source. Which ids a block
    has is told by bitmaps, one row for 32,768 ids that lie together; where
    they are too many to broadcast, edges are shuffled by destination as well.
    """
    # a vertex may have several rows, but only one block
    least, most = F.min("block_id"), F.max("block_id")
    two = F.raise_error(F.concat(F.lit("two blocks for vertex "), F.col("src"))).cast("bigint")
    members = blocks.groupBy("src").agg(F.when(least.eqNullSafe(most), least).otherwise(two).alias("block_id"))
    members = cut(members)
    of_src = members.withColumnRenamed("block_id", "_from")
    found = lookup(edges, "src", of_src, group_sizes(edges, "src", limits).heavy)
    bitmaps = cut(
        members.where("block_id is not null")
        .groupBy(F.col("block_id").alias("_block"), F.bitmap_bucket_number("src").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("src")).alias("_bits"))
    )
    if bitmaps.count() <= min(MOST_BITMAPS, limits.broadcast_rows):
        # the edges stay where their sources' blocks are
        here = (F.col("_from") == F.col("_block")) & (F.bitmap_bucket_number("dst") == F.col("_bucket"))
        found = found.join(F.broadcast(bitmaps), here, "left")
        local = F.coalesce(has_bit(F.col("_bits"), F.bitmap_bit_position("dst")), F.lit(False))
    else:
        of_dst = members.select(F.col("src").alias("dst"), F.col("block_id").alias("_to"))
        found = lookup(found, "dst", of_dst, group_sizes(edges, "dst", limits).heavy)
        local = F.coalesce(F.col("_from") == F.col("_to"), F.lit(False))
    return found.select(*[found[name] for name in edges.columns], local.alias("is_local"))
