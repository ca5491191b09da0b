"""Positions in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adjrank.session import cut

# monotonically_increasing_id() keeps the partition above the low 33 bits.
ROW_BITS = 33


def rank_order() -> list[Column]:
    return [F.desc("rank"), F.asc("id")]


def global_index(df: DataFrame, order: list | None = None, unique: bool = True) -> DataFrame:
    """Add ``pos``, the row's place 0, 1, … in the total order.

    Rows are range-partitioned and sorted, then numbered inside their
    partition; only the partitions' sizes are summed up. ``order`` defaults to
    descending rank. With ``unique=False`` equal rows are told apart first, so
    that many copies of one row do not end up in one partition.
    """
    order = rank_order() if order is None else order
    columns = df.columns
    if not unique:
        # The copy number is taken from a checkpoint, so a retried task sees the same one.
        df = cut(df).withColumn("_copy", F.monotonically_increasing_id())
        order = [*order, F.asc("_copy")]
    return number_rows(df.orderBy(*order)).select(*columns, "pos")


def save_sorted(df: DataFrame, path: str, order: list | None = None, mode: str = "error") -> None:
    """Store rows in their total order, by default descending rank; see :func:`load_positions`."""
    df.orderBy(*(rank_order() if order is None else order)).write.mode(mode).parquet(path)


def load_positions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`save_sorted` with ``pos``, their place 0, 1, … in its order.

    Files follow each other by their number, and rows by their place in the
    file, so nothing is sorted again: one row per file is summed up.
    """
    stored = spark.read.parquet(path)
    columns = stored.columns
    name = F.col("_metadata.file_name")
    number = [F.regexp_extract(name, pattern, 1).cast("bigint") for pattern in (r"^part-(\d+)", r"-c(\d+)")]
    placed = stored.select(*columns, F.struct(*number).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_file").count().select("_file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_file").select(*columns, (F.col("_offset") + F.col("_row")).alias("pos"))


def number_rows(df: DataFrame) -> DataFrame:
    """Add ``pos``, the row's place 0, 1, … in the order in which ``df`` delivers its rows."""
    columns = df.columns
    placed = cut(df).withColumn("_row", F.monotonically_increasing_id())
    partition = F.shiftright("_row", ROW_BITS)
    within = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    # One row per partition, numbered by running sum.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(partition.alias("_part"))
        .count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_part", partition)
        .join(F.broadcast(offsets), "_part")
        .select(*columns, (F.col("_offset") + within).alias("pos"))
    )
