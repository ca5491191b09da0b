"""How a graph is laid out for repeated products."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjrank.operators.placement import partition_keys, spread_evenly
from adjrank.operators.skew import split_heavy
from adjrank.session import Limits, cut, cut_and_measure, shuffle_partitions, stored, stored_in_buckets


def start_vector(ranked: DataFrame, limits: Limits, buckets: int | None = None) -> StartVector:
    """Read the vertices of ranked rows: their rank, degree and number.

    The rows of one vertex have to differ in ``segment``; without that column
    a vertex has one row. ``buckets`` is how many the rows' table has by ``src``.
    """
    row = ["id"] + ["segment"] * ("segment" in ranked.columns)
    rows = (
        ranked.withColumnRenamed("src", "id")
        .groupBy(*row)
        .agg(
            F.max("rank").alias("rank"),
            F.sum(F.size("dst")).alias("deg"),
            F.count("*").alias("copies"),
        )
    )
    if "segment" in row:
        rows = rows.groupBy("id").agg(
            F.max("rank").alias("rank"), F.sum("deg").alias("deg"), F.max("copies").alias("copies"), F.count("*").alias("rows")
        )
    else:
        rows = rows.withColumn("rows", F.lit(1))
    facts = {
        "vertices": F.count("*"),
        "links": F.sum("deg"),
        "largest": F.max("deg"),
        "repeated": F.count_if(F.col("copies") > 1),
        "most": F.max("rows"),
    }
    vector, seen = cut_and_measure(rows, *(fact.alias(name) for name, fact in facts.items()))
    vertices, links, largest, repeated, most = (seen.get(name) for name in facts)
    vertices, repeated = vertices or 0, repeated or 0
    if repeated:
        raise ValueError(f"{repeated} vertices have several rows; number them in a column 'segment'")
    return StartVector(ranked, vector.drop("copies", "rows"), vertices, links or 0, largest or 0, (most or 0) > 1, limits, buckets)


@dataclass(frozen=True)
class StartVector:
    """The rows a loop starts from and their vertices, ``(id, rank, deg)``."""

    ranked: DataFrame
    vector: DataFrame
    vertices: int
    links: int
    largest: int
    split_up: bool
    limits: Limits
    buckets: int | None = None

    @property
    def partitions(self) -> int:
        """Partitions of the loop: the rows' buckets, else the session's number or more if a task would get too many links."""
        return self.buckets or max(shuffle_partitions(self.ranked.sparkSession), -(-self.links // self.limits.task_links))

    @property
    def rows(self) -> DataFrame:
        """Rows without their rank."""
        return self.ranked.select(*[c for c in ("src", "segment", "dst") if c in self.ranked.columns])

    @property
    def segmented(self) -> bool:
        """Whether rows have the column; ``split_up`` tells whether any vertex has several rows."""
        return "segment" in self.ranked.columns

    @property
    def small(self) -> bool:
        """Whether the ranks of all vertices with a row may be broadcast."""
        return self.vertices <= self.limits.broadcast_rows

    @cached_property
    def heavy_ids(self) -> DataFrame | None:
        """Vertices with too many links for one task; few enough to broadcast."""
        limit = self.limits.heavy_above(self.links)
        if self.small or self.largest <= limit:
            return None
        return cut(self.vector.where(F.col("deg") > limit).select("id"))

    def senders(self, vector: DataFrame) -> DataFrame:
        """The ranks of vertices with a row, few enough to broadcast when ``small``."""
        return vector.join(F.broadcast(self.vector.select("id")), "id", "left_semi")

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows of ordinary and of heavy vertices."""
        if self.heavy_ids is None:
            return rows, None
        return split_heavy(rows, "src", self.heavy_ids.withColumnRenamed("id", "src"))

    def place_blocks(self, block: Callable[[Column], Column]) -> Placement | None:
        """The partitions of blocks, such that links are spread evenly; None if they cannot be.

        Where blocks are too many for a broadcast, groups of them are dealt, as many as may be broadcast.
        """
        light, most = self.vector, self.limits.broadcast_rows
        if self.heavy_ids is not None:
            light = light.join(F.broadcast(self.heavy_ids), "id", "left_anti")
        weight = F.sum("deg").alias("weight")
        sums = cut(light.groupBy(block(F.col("id")).alias("group")).agg(weight))
        blocks = sums.count()
        if blocks > most:
            own, block = block, lambda vertex: F.pmod(F.xxhash64(own(vertex)), F.lit(most))
            sums = cut(light.groupBy(block(F.col("id")).alias("group")).agg(weight))
        partitions = self.partitions
        groups, largest = sums.agg(F.count("*"), F.max("weight")).first()
        if groups < partitions or largest > max(self.limits.max_links, self.links // partitions):
            return None
        keys = partition_keys(sums.sparkSession, partitions)
        placed = spread_evenly(sums, "group", "weight", partitions).join(F.broadcast(keys), "partition")
        return Placement(block, cut(placed.select("group", "part")), partitions)

    def lay_out(
        self,
        columns: list[str],
        derive: Callable[[DataFrame, Callable], DataFrame] = lambda rows, own: rows,
        block: Callable[[Column], Column] | None = None,
    ) -> Layout:
        """Partition and store the links, keeping ``columns`` of ``derive(rows, own)``.

        They go to sorted, bucketed tables in the checkpoint folder, which every step reads without a shuffle. Rows that
        come from such a table by ``src`` stay there.

        ``derive`` may join facts about the vertices, one row per ``src``, as
        ``rows.join(own(facts), "src")``. With ``block`` the rows of a block of
        vertices go to one partition, blocks dealt to partitions by weight, unless that cannot be even.
        """
        rows = self.rows.where(F.size("dst") > 0)
        degrees = self.vector.select(F.col("id").alias("src"), "deg")
        partitions = self.partitions

        def ready(part: DataFrame, own: Callable) -> DataFrame:
            """Rows of some vertices with their degree; ``own`` selects these vertices' facts."""
            if self.split_up:
                part = part.join(own(degrees), "src")
            else:
                part = part.withColumn("deg", F.size("dst").cast("bigint"))
            return derive(part, own).select("src", "deg", *columns)

        # Where ranks are broadcast, any even spread of the rows will do.
        spread = ["src"] + ["segment"] * self.split_up
        if self.small:
            rows = rows.repartition(partitions, *spread)
            keys = self.vector.select(F.col("id").alias("src"))
            # facts may cover ids without a row, of which there is no bound
            held = ready(rows, lambda facts: F.broadcast(facts.join(F.broadcast(keys), "src", "left_semi")))
            return Layout(self, stored(held, "links"), None)

        rows, heavy = self.split(rows)
        if heavy is not None:
            keys = F.broadcast(self.heavy_ids.withColumnRenamed("id", "src"))
            heavy = heavy.repartition(partitions, *spread)
            heavy = stored(ready(heavy, lambda facts: F.broadcast(facts.join(keys, "src", "left_semi"))), "heavy_links")
        placement = None if block is None else self.place_blocks(block)
        if placement is not None:
            light = placement.of(ready(rows, lambda facts: facts), "src", "part")
            return Layout(self, stored_in_buckets(light, "links", partitions, "part", ["part", "src"]), heavy, placement)
        if self.buckets and not self.split_up and heavy is None:
            return Layout(self, ready(rows, lambda facts: facts), None)
        light = ready(rows.repartition(partitions, "src"), lambda facts: facts)
        return Layout(self, stored_in_buckets(light, "links", partitions, "src", ["src"]), heavy)

    def attach_links(self, vector: DataFrame) -> DataFrame:
        """Ranked rows of a later vector; ids without a row get an empty list."""
        light, heavy = self.split(self.rows)
        here = F.col("id") == F.col("src")
        if self.small:
            found = light.join(F.broadcast(self.senders(vector)), here)
        else:
            found = light.join(vector, here)
        if heavy is not None:
            ranks = vector.join(F.broadcast(self.heavy_ids), "id", "left_semi")
            found = found.unionByName(heavy.join(F.broadcast(ranks), here))
        fresh = (
            vector.join(self.vector.select("id"), "id", "left_anti")
            .withColumn("src", F.col("id"))
            .withColumn("dst", F.array().cast("array<bigint>"))
        )
        if self.segmented:
            fresh = fresh.withColumn("segment", F.lit(0).cast("bigint"))
        return found.unionByName(fresh).select(*self.rows.columns, "rank")


@dataclass(frozen=True)
class Placement:
    """Groups of vertices and where they go: ``parts`` is ``(group, part)``, few enough to broadcast.

    ``part`` is a key that Spark hashes to the wanted partition, so that no two
    partitions' groups meet in one.
    """

    group: Callable[[Column], Column]
    parts: DataFrame
    partitions: int

    def of(self, rows: DataFrame, vertex: str, name: str) -> DataFrame:
        """Add the part of each row's vertex; a group without links may go anywhere."""
        parts = self.parts.select(F.col("group").alias("_group"), F.col("part").alias("_part"))
        found = rows.withColumn("_group", self.group(F.col(vertex))).join(F.broadcast(parts), "_group", "left")
        return found.withColumn(name, F.coalesce("_part", "_group")).drop("_part", "_group")


@dataclass
class Layout:
    """Stored links, laid out once for all steps of a loop.

    light   rows ``(src, deg, …)`` in one partitioning for all steps
    heavy   rows of the few vertices with very many links, spread evenly, or None
    placement  where blocks go if rows and vectors are partitioned by blocks, as
            the columns ``part`` and ``of`` tell; else they are by vertex
    grown   ids without a row have made the vector too long to broadcast
    """

    start: StartVector
    light: DataFrame
    heavy: DataFrame | None
    placement: Placement | None = None
    grown: bool = False

    def sent_by(self, vector: DataFrame, columns: list[str]) -> DataFrame:
        """``columns`` of every vertex's links, with the vector's columns and ``deg``.

        Three ways, by checked size: broadcast a small vector; let the light
        rows meet it in their partitioning; broadcast the ranks of the heavy
        vertices only, so that their rows stay spread out.
        """
        columns = ["src", "deg", *columns]
        here = F.col("id") == F.col("src")
        if self.start.small:
            ranks = self.start.senders(vector) if self.grown else vector
            return self.light.select(*columns).join(F.broadcast(ranks), here)
        sent = self.sent_by_light(vector, columns[2:])
        if self.heavy is None:
            return sent
        return sent.unionByName(self.sent_by_heavy(vector, columns[2:]))

    def sent_by_light(self, vector: DataFrame, columns: list[str]) -> DataFrame:
        """The part of ``sent_by`` that keeps the partitioning, of a vector not small."""
        here = F.col("id") == F.col("src")
        if self.placement is None:
            return vector.join(self.light.select("src", "deg", *columns).hint("merge"), here)
        here &= F.col("of") == F.col("part")
        return vector.join(self.light.select("part", "src", "deg", *columns).hint("merge"), here).drop("part")

    def sent_by_heavy(self, vector: DataFrame, columns: list[str]) -> DataFrame:
        """The part of ``sent_by`` for the heavy vertices."""
        here = F.col("id") == F.col("src")
        ranks = vector.join(F.broadcast(self.start.heavy_ids), "id", "left_semi")
        return self.heavy.select("src", "deg", *columns).join(F.broadcast(ranks), here)

    def place(self, vector: DataFrame) -> DataFrame:
        """Bring a vector to the partitions of its blocks, if rows are placed so."""
        if self.placement is None or "of" in vector.columns:
            return vector
        return self.placement.of(vector, "id", "of").repartition(self.start.partitions, "of")
