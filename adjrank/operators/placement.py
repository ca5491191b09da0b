"""Dealing groups of very different weight to partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjrank.functions.blocks import integer_div
from adjrank.operators.position import global_index


def spread_evenly(groups: DataFrame, key: str, weight: str, partitions: int) -> DataFrame:
    """``(key, partition)``: groups dealt to partitions, the heaviest first, to and fro.

    Two partitions' weights differ by no more than the heaviest group's.
    """
    if partitions < 1:
        raise ValueError("need at least one partition")
    placed = global_index(groups.select(key, weight), [F.desc(weight), F.asc(key)])
    turn, place = integer_div(F.col("pos"), partitions), F.col("pos") % partitions
    back = F.lit(partitions - 1) - place
    return placed.select(key, F.when(turn % 2 == 0, place).otherwise(back).cast("int").alias("partition"))


def partition_keys(spark: SparkSession, partitions: int) -> DataFrame:
    """``(partition, part)``: for each partition a bigint that Spark's hash partitioning sends there."""
    # so many numbers that none of the partitions is missed
    numbers = spark.range(64 * partitions).select(F.col("id").alias("part"), F.pmod(F.hash("id"), F.lit(partitions)).alias("partition"))
    return numbers.groupBy("partition").agg(F.min("part").alias("part"))
