"""Graphs derived from order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjrank.operators.convert import attach_rank, edges_to_adjacency
from adjrank.operators.position import global_index
from adjrank.operators.skew import group_sizes, split_heavy
from adjrank.session import DEFAULT_LIMITS, Limits, stored

# Line numbers repeat within an order; the further columns settle the order of lines.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def part_id(key: Column) -> Column:
    """Vertex of a part in a graph with parts and suppliers: the even numbers."""
    return key * 2


def supplier_id(key: Column) -> Column:
    """Vertex of a supplier there: the odd numbers, so that no size of the tables lets the two meet."""
    return key * 2 + 1


def basket_edges(lineitem: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Different edges from a part to the next part of the same order.

    Orders with too many lines for one task are taken out of the window and
    put in order by a range sort; their neighbours meet by position.
    """
    lines = lineitem.select(*LINE_ORDER)
    # a count of a table reads no more than its files' footers
    heavy = group_sizes(lines, "l_orderkey", limits, lineitem.count()).heavy
    if heavy is None:
        steps = _next_in_window(lines)
    else:
        light, many = split_heavy(lines, "l_orderkey", heavy)
        steps = _next_in_window(light).unionAll(_next_by_position(many))
    return steps.where("dst is not null and src <> dst").distinct()


def _next_in_window(lines: DataFrame) -> DataFrame:
    in_order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER[1:])
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(in_order).alias("dst"))


def _next_by_position(lines: DataFrame) -> DataFrame:
    placed = global_index(lines, [F.asc(name) for name in LINE_ORDER], unique=False)
    here = placed.select("pos", "l_orderkey", F.col("l_partkey").alias("src"))
    after = placed.select((F.col("pos") - 1).alias("pos"), "l_orderkey", F.col("l_partkey").alias("dst"))
    return here.join(after, ["pos", "l_orderkey"]).select("src", "dst")


def basket_rows(lineitem: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Basket graph as ranked rows, stored because the operators read a graph twice."""
    return ranked_rows(basket_edges(lineitem, limits), limits)


def ranked_rows(edges: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    edges = stored(edges, "edges")
    return stored(attach_rank(edges_to_adjacency(edges, limits, edges.count())), "rows")


def supply_edges(lineitem: DataFrame, both_ways: bool = False) -> DataFrame:
    """One edge per line from its part to its supplier, and back; repeated edges stay."""
    part, supplier = part_id(F.col("l_partkey")), supplier_id(F.col("l_suppkey"))
    there = F.struct(part.alias("src"), supplier.alias("dst"))
    back = F.struct(supplier.alias("src"), part.alias("dst"))
    edges = [there, back] if both_ways else [there]
    return lineitem.select(F.inline(F.array(*edges)))


def mixed_edges(lineitem: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Basket edges and one edge per line to its supplier; suppliers have no row of their own."""
    baskets = basket_edges(lineitem, limits).select(part_id(F.col("src")).alias("src"), part_id(F.col("dst")).alias("dst"))
    return baskets.unionAll(supply_edges(lineitem))
