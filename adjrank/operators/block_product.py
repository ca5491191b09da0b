"""Block-partitioned product with local passes.

Vertices are grouped into blocks. A link is local when its destination has a
row in the source's block, else external. One step

1. lets every vertex with local in-links replace its rank by ``inner`` times
   the sum of ``rank / out-degree`` over them (the local passes all add up the
   same old ranks, so their number is a factor), and
2. gives every vertex the sum of ``rank / out-degree`` over its external
   in-links, with the ranks of 1.

Local links thus count through 1 only. The out-degree is that of all links.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjrank.functions.blocks import block_of, check_block_size
from adjrank.operators.blocks import BY, block_bounds
from adjrank.operators.layout import Layout, start_vector
from adjrank.operators.product import finish, iterate, known, total
from adjrank.session import DEFAULT_LIMITS, Limits, cut
from adjrank.sources.generator import BLOCK_SIZE


def partitioned_matvec(
    ranked: DataFrame, block_size: int = BLOCK_SIZE, inner: int = 1, by: str = "range", limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """One block step on ranked rows; see :func:`partitioned_matvec_iterate`."""
    return partitioned_matvec_iterate(ranked, block_size, outer=1, inner=inner, by=by, limits=limits)


def partitioned_matvec_iterate(
    ranked: DataFrame,
    block_size: int = BLOCK_SIZE,
    outer: int | None = None,
    inner: int = 1,
    threshold: float | None = None,
    by: str = "range",
    output: str = "rows",
    max_iterations: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    keep: str | None = None,
) -> DataFrame:
    """Repeat the block step; options and result as in :func:`~adjrank.operators.matvec_iterate`.

    Blocks are ``block_size`` consecutive ids (``by='range'``) or consecutive
    rows in id order (``by='position'``). From the second step on, ids that had
    no row have one, so that links to them can be local.
    """
    check_block_size(block_size)
    if by not in BY:
        raise ValueError(f"by must be one of {', '.join(BY)}")
    if inner < 0:
        raise ValueError("inner must not be negative")
    start = start_vector(ranked, limits)
    block = partial(block_of, block_size=block_size) if by == "range" else None

    def lay_out(ids: DataFrame) -> Layout:
        return start.lay_out(["near", "far"], partial(_split_links, block_size, by, ids), block)

    def step(vector: DataFrame, layout: Layout, first: bool) -> DataFrame:
        return block_step(vector, layout, inner, first)

    vector = iterate(
        start, lay_out, step, outer, threshold, max_iterations, by_ids=by == "position", keep=keep
    )
    return finish(start, vector, output)


def _split_links(block_size: int, by: str, ids: DataFrame, rows: DataFrame, own: Callable) -> DataFrame:
    """Split the links of every row into ``near``, inside its block's id interval, and ``far``."""
    src, low, high = F.col("src"), F.col("low"), F.col("high")
    if by == "range":
        rows = rows.withColumn("low", src - F.pmod(src, F.lit(block_size)))
        rows = rows.withColumn("high", low + F.lit(block_size - 1))
    else:
        rows = rows.join(own(block_bounds(ids, block_size).withColumnRenamed("id", "src")), "src")
    return rows.withColumn("near", F.filter("dst", lambda link: link.between(low, high))).withColumn(
        "far", F.filter("dst", lambda link: ~link.between(low, high))
    )


def block_step(vector: DataFrame, layout: Layout, inner: int, first: bool) -> DataFrame:
    """One block step.

    In the first step a destination in the block's interval may have no row;
    its links are external. Whether it has one is known where its sums meet, so
    both sums are formed and no link has to look up its destination.
    """
    share = (F.col("rank") / F.col("deg")).alias("part")
    vector = layout.place(vector)
    local = local_ranks(vector, layout, inner) if inner else vector
    if inner and layout.heavy is not None:
        local = cut(local)  # read twice, by light and by heavy rows
    if not first:
        far = layout.sent_by(local, ["far"]).select(F.explode("far").alias("id"), share)
        return layout.place(total(known(vector), far))

    sent = layout.sent_by(local, ["near", "far"]).select(
        F.size("far").alias("border"), share, F.posexplode(F.concat("far", "near")).alias("at", "id")
    )
    is_far = F.col("at") < F.col("border")
    received = sent.select(
        "id",
        F.when(is_far, F.col("part")).alias("far"),
        F.when(~is_far, F.col("part")).alias("near"),
        F.lit(False).alias("has_row"),
        F.lit(None).cast("double").alias("old"),
    )
    nothing = F.lit(None).cast("double")
    ids = vector.select("id", nothing.alias("far"), nothing.alias("near"), F.lit(True).alias("has_row"), F.col("rank").alias("old"))
    sums = ids.unionAll(received).groupBy("id").agg(
        F.sum("far").alias("far"), F.sum("near").alias("near"), F.max("has_row").alias("has_row"), F.max("old").alias("old")
    )
    near = F.when(F.col("has_row"), F.lit(0.0)).otherwise(F.coalesce("near", F.lit(0.0)))
    return layout.place(sums.select("id", (F.coalesce("far", F.lit(0.0)) + near).alias("rank"), "old"))


def local_ranks(vector: DataFrame, layout: Layout, inner: int) -> DataFrame:
    """Ranks after the local passes, for every id of the vector."""
    share = (F.col("rank") / F.col("deg")).alias("part")
    if layout.placement is not None:
        # A block's rows and ranks share a partition, and local links stay in their block.
        ids, sums = vector.select("of", "id", "rank"), []
        sent = layout.sent_by_light(ids, ["near"]).select("of", F.explode("near").alias("id"), share)
        sums.append(sent.groupBy("of", "id").agg(F.sum("part").alias("light")))
        if layout.heavy is not None:
            sent = layout.sent_by_heavy(ids, ["near"]).select("of", F.explode("near").alias("id"), share)
            sent = sent.groupBy("id").agg(F.sum("part").alias("heavy"))
            sums.append(layout.place(sent))
        for received in sums:
            ids = ids.join(received.hint("merge"), ["of", "id"], "left")
        parts = [F.col(name) for name in ("light", "heavy") if name in ids.columns]
        part = parts[0] if len(parts) == 1 else F.coalesce(parts[0] + parts[1], *parts)
    else:
        nothing = F.lit(None).cast("double")
        near = layout.sent_by(vector, ["near"]).select(F.explode("near").alias("id"), nothing.alias("rank"), share)
        ids = vector.select("id", "rank", nothing.alias("part")).unionAll(near).groupBy("id")
        ids = ids.agg(F.max("rank").alias("rank"), F.sum("part").alias("part"))
        # An id without a row has no rank here; it sends nothing.
        ids, part = ids.where(F.col("rank").isNotNull()), F.col("part")
    rank = F.coalesce(part * F.lit(inner), F.col("rank")).alias("rank")
    return ids.select(*[c for c in ("of", "id") if c in ids.columns], rank)
