"""Tables that are stored on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from adjrank.session import reread, scratch_path

#: Parts of a stored table, at most (Spark's own limit).
MOST_PARTS = 100_000


def bucketed(df: DataFrame, name: str, parts: int, by: str) -> DataFrame:
    """``df`` as a stored table in ``parts`` by ``by``; joins by it do not move its rows."""
    table = f"{name}_{uuid.uuid4().hex}"
    path = scratch_path(df.sparkSession, name)
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd")
    writer.bucketBy(max(1, min(parts, MOST_PARTS)), by).saveAsTable(table)
    return df.sparkSession.table(table)


class Scratch:
    """Stored tables, each emptied when it is used up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths[name] = path, df.schema
        return reread(df, path)

    def empty(self, name: str) -> None:
        """Free the table's space; nothing that is still to be computed may read it."""
        path, schema = self.paths.pop(name)
        self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)
