"""Session-level helpers: cutting lineage and size limits."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession


@dataclass(frozen=True)
class Limits:
    """Sizes that decide how the work is spread, never its results.

    max_links       most links in a row that an operator builds, and the size
                    from which a group may count as too large for one task
    broadcast_rows  most rows that are ever broadcast
    task_links      links that one task of a loop works on, at most
    """

    max_links: int = 1 << 20
    broadcast_rows: int = 500_000
    task_links: int = 1 << 24

    def __post_init__(self):
        if min(self.max_links, self.broadcast_rows, self.task_links) < 1:
            raise ValueError("limits must be at least 1")

    def heavy_above(self, total: int) -> int:
        """Group size above which a key counts as heavy.

        Fewer than ``total / heavy_above(total) <= broadcast_rows`` keys can
        be larger, so the list of heavy keys is always safe to broadcast.
        """
        return max(self.max_links, -(-total // self.broadcast_rows))


DEFAULT_LIMITS = Limits()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session, from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own;
    on a cluster the folder has to be shared, so a missing one is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="adjrank-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, for intermediate files."""
    return posixpath.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_measure(df: DataFrame, *facts: Column) -> tuple[DataFrame, dict]:
    """The same, with aggregates of the rows that are taken while they are written, by no job of their own."""
    seen = Observation()
    return cut(df.observe(seen, *facts)), seen.get


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the checkpoint folder as Parquet and read again, so that readers get only their columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return reread(df, path)


def reread(df: DataFrame, path: str) -> DataFrame:
    """What was written of ``df``; its columns are known, so no job has to look for them."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_buckets(df: DataFrame, name: str, parts: int, by: str, order: list[str]) -> DataFrame:
    """``df`` as a table in ``parts`` buckets by a column, each one sorted file, in the checkpoint folder.

    Joins and groupings by that column into as many partitions read it without a shuffle.
    """
    placed = df.repartition(parts, by).sortWithinPartitions(*order)
    table = f"{name}_{uuid.uuid4().hex}"
    writer = placed.write.format("parquet").option("path", scratch_path(df.sparkSession, name))
    writer.bucketBy(parts, by).sortBy(*order).saveAsTable(table)
    return df.sparkSession.table(table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Keep partitionings through checkpoints, accept one by some of the join keys, and know that a bucket's one file is sorted.
STATIC = {
    # every id has its links: a runtime filter would read them once more for nothing
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


@contextmanager
def static_plans(spark: SparkSession, partitions: int | None = None):
    """Plan with the partitioning the data has, inside the block.

    A checkpoint of an adaptive plan forgets how its rows are partitioned. In
    a loop that costs one more shuffle per step, and the loops here are
    balanced by construction, so there is nothing for AQE to repair.
    """
    settings = STATIC | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
