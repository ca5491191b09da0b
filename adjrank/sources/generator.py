"""Synthetic graphs with block locality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjrank.functions.blocks import block_of
from adjrank.functions.draws import with_distinct_draws, with_mixed, with_streams

# Published defaults: part of a vertex's links that leave its block, and vertices in a block.
BORDER_RATIO = 0.1
BLOCK_SIZE = 65536


def generate_blocked_graph(
    spark: SparkSession,
    n: int,
    degree: int,
    border_ratio: float = BORDER_RATIO,
    block_size: int = BLOCK_SIZE,
    seed: int = 0,
) -> DataFrame:
    """Ranked rows of a random graph on the vertices ``0 .. n-1``.

    Every vertex has ``k`` links, ``k`` uniform in ``[0, 2 * degree)``:
    ``floor(border_ratio * k)`` different ones outside its block, the rest
    different ones inside, never itself; links ascend and the rank is 1.0. A
    block is ``block_size`` consecutive vertices, at least ``2 * degree``.
    Where fewer vertices are available than links wanted (a single block, a
    short last one), all of them are linked.

    No shuffle: a row depends on its vertex and the seed only.
    """
    if n < 0 or degree < 1 or block_size < 1:
        raise ValueError("need n >= 0, degree >= 1 and block_size >= 1")
    if not 0.0 <= border_ratio <= 1.0:
        raise ValueError("border_ratio must lie in [0, 1]")
    block_size = max(block_size, 2 * degree)

    src, start, members = F.col("src"), F.col("start"), F.col("members")
    k, border = F.col("k"), F.col("border")
    df = (
        spark.range(n)
        .select(F.col("id").alias("src"))
        .withColumn("start", block_of(src, block_size) * block_size)
        .withColumn("members", F.least(F.lit(n) - start, F.lit(block_size)).cast("bigint"))
    )
    df = with_streams(df, src, seed, ["of_degree", "of_near", "of_far"])
    df = with_mixed(df, "k", F.col("of_degree")).withColumn("k", k % (2 * degree))
    # Single precision: the ratio is a float wherever this graph is defined.
    df = df.withColumn("border", F.floor(F.lit(border_ratio).cast("float") * k.cast("float")))
    df = with_distinct_draws(df, "near", src, F.col("of_near"), k - border, members - 1)
    df = with_distinct_draws(df, "far", src, F.col("of_far"), border, F.lit(n) - members)

    # The picks skip the vertex itself, and its block.
    near = F.transform("near", lambda p: F.when(start + p < src, start + p).otherwise(start + p + 1))
    far = F.transform("far", lambda p: F.when(p < start, p).otherwise(p + members))
    dst = F.array_sort(F.concat(near, far))
    # Out of a generator, no later filter on the list can compute it a second time.
    return df.select("src", F.explode(F.array(dst)).alias("dst")).withColumn("rank", F.lit(1.0))
