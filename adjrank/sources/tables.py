"""Typed graph tables in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed column types of a stored graph; segment and rank are optional.
TYPES = {
    "src": T.LongType(),
    "segment": T.LongType(),
    "dst": T.ArrayType(T.LongType()),
    "rank": T.DoubleType(),
}


def _typed(graph: DataFrame) -> DataFrame:
    present = [name for name in TYPES if name in graph.columns]
    missing = {"src", "dst"} - set(present)
    if missing:
        raise ValueError(f"not an adjacency table, missing {sorted(missing)}")
    return graph.select(*[graph[name].cast(TYPES[name]) for name in present])


def _chosen(graph: DataFrame, ranked: bool) -> DataFrame:
    return graph.select(*[name for name in TYPES if name in graph.columns and (ranked or name != "rank")])


def _order(graph: DataFrame) -> list[str]:
    return [name for name in ("src", "segment") if name in graph.columns]


def save_graph(graph: DataFrame, path: str, mode: str = "error", clustered: bool = False) -> None:
    """Store adjacency rows, ranked or not, with the fixed column types.

    ``clustered`` sorts them by vertex first, so that a range of vertices is in
    few files and row groups; their minima and maxima tell readers which.
    """
    rows = _typed(graph)
    if clustered:
        rows = rows.repartitionByRange(*_order(rows)).sortWithinPartitions(*_order(rows))
    rows.write.mode(mode).parquet(path)


def load_graph(
    spark: SparkSession, path: str, ranked: bool = True, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Read a graph written by :func:`save_graph`, with the columns that were stored.

    ``ranked=False`` leaves a stored rank out. With ``first`` or ``last`` only
    the rows of vertices from the one to the other, both included; of a
    clustered graph no other files and row groups are read.
    """
    graph = _chosen(spark.read.parquet(path), ranked)
    if first is not None:
        graph = graph.where(F.col("src") >= first)
    return graph if last is None else graph.where(F.col("src") <= last)


def load_split(
    spark: SparkSession, path: str, n_vertices: int, n_splits: int, split: int, ranked: bool = True
) -> DataFrame:
    """Read one of the ranges that :func:`~adjrank.operators.vertex_ranges` cuts ``[0, n_vertices)`` into."""
    if not 0 <= split < n_splits:
        raise ValueError(f"split must lie in [0, {n_splits})")
    size, spill = divmod(n_vertices, n_splits)
    first = split * size + min(split, spill)
    return load_graph(spark, path, ranked, first, first + size + (split < spill) - 1)


def save_buckets(graph: DataFrame, table: str, path: str, buckets: int, mode: str = "error") -> None:
    """Store adjacency rows as a table of the session's catalog, in sorted buckets by vertex.

    Every bucket is one file. A loop over the loaded rows (``buckets=`` of
    :func:`~adjrank.operators.matvec_iterate`) reads them where they are: they
    are neither shuffled nor cached.
    """
    rows = _typed(graph)
    placed = rows.repartition(buckets, "src").sortWithinPartitions(*_order(rows))
    writer = placed.write.format("parquet").mode(mode).option("path", path)
    writer.bucketBy(buckets, "src").sortBy(*_order(rows)).saveAsTable(table)


def load_buckets(spark: SparkSession, table: str, ranked: bool = True) -> DataFrame:
    """Read a table written by :func:`save_buckets`."""
    return _chosen(spark.table(table), ranked)
