"""Connected components of an edge list, by hooking on smaller neighbours and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjrank.session import stored


def _roots(moves: DataFrame) -> DataFrame:
    """``at`` and the end ``to`` of its chain of moves; chains go to ever smaller nodes.

    All chains are halved at once, so there are as many joins as their longest
    has binary digits.
    """
    while True:
        further = moves.select(F.col("at").alias("to"), F.col("to").alias("further"))
        jumped = moves.join(further, "to", "left")
        moves = stored(jumped.select("at", F.coalesce("further", "to").alias("to"), (F.col("further") < F.col("to")).alias("moved")), "moves")
        if moves.where("moved").isEmpty():
            return moves.select("at", "to")
        moves = moves.select("at", "to")


def contract(edges: DataFrame) -> list[DataFrame]:
    """Rounds ``(at, to)`` that take every node of edges ``a``, ``b`` (bigint) to the smallest of its component.

    In a round every node hooks on its smallest neighbour, if that is smaller
    than itself, and goes to the root of the tree that this makes; edges
    between roots are left. A root is smaller than all its neighbours, so it
    takes them in, or it is next to one that a smaller root took in, and then
    hooks in the next round: roots at least halve in two rounds. A node's
    neighbours meet as partial minima, so a hub is no hot key.
    """
    edges, rounds = stored(edges.where("a <> b").select("a", "b").distinct(), "links"), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("b"))
        moves = _roots(stored(least.select("at", F.least("at", "b").alias("to")), "moves"))
        rounds.append(moves)
        first = edges.join(moves, edges.a == moves.at).select(F.col("to").alias("a"), "b")
        second = first.join(moves, first.b == moves.at).select("a", F.col("to").alias("b"))
        edges = stored(second.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return rounds


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node in edges ``a``, ``b`` (bigint).

    Edges with nulls and loops are ignored. Every step is a table in the
    checkpoint folder, so plans stay short and sizes are those of files.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node"))
    rounds = contract(edges)
    if not rounds:
        return nodes.where("false").select("node", F.col("node").alias("component"))
    # from the last round, which has the fewest nodes, back to the first, which has all
    placed = rounds[-1]
    for moves in reversed(rounds[:-1]):
        further = placed.select(F.col("at").alias("to"), F.col("to").alias("further"))
        placed = stored(moves.join(further, "to", "left").select("at", F.coalesce("further", "to").alias("to")), "placed")
    return placed.select(F.col("at").alias("node"), F.col("to").alias("component"))


def extended(joined: DataFrame, edges: DataFrame) -> DataFrame:
    """``joined``, the components of some edges, when more ``edges`` are added; only their ends' components are worked on."""
    for end in ("a", "b"):
        placed = joined.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
        edges = edges.join(placed, end, "left").withColumn(end, F.coalesce(f"{end}_in", end)).drop(f"{end}_in")
    more = connected_components(edges).withColumnRenamed("component", "further")
    held = joined.join(more.withColumnRenamed("node", "component"), "component", "left")
    held = held.select("node", F.coalesce("further", "component").alias("component"))
    new = more.join(joined, "node", "left_anti").select("node", F.col("further").alias("component"))
    return stored(held.unionByName(new), "joined")
