"""Matrix-vector product along the links, and its iteration.

One step gives every vertex the sum of ``rank / out-degree`` over its
in-links, each repeated link counting again. There is no damping and no
teleport, and the rank of a vertex without links is lost: this is not PageRank.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjrank.operators.layout import Layout, StartVector, start_vector
from adjrank.session import DEFAULT_LIMITS, Limits, cut_and_measure, static_plans

log = logging.getLogger(__name__)

OUTPUTS = ("rows", "vector")


class NotSettled(RuntimeError):
    """Ranks that still move after the most steps allowed; ``vector`` has those of the last one."""

    def __init__(self, vector: DataFrame, steps: int, moving: int):
        super().__init__(f"{moving} ranks still moving after {steps} steps")
        self.vector, self.steps, self.moving = vector, steps, moving


def step_path(keep: str, step: int) -> str:
    return f"{keep.rstrip('/')}/step={step}"


def kept_step(spark: SparkSession, keep: str, step: int) -> DataFrame:
    """The vector ``(id, rank)`` after a step of a loop that had the folder ``keep``."""
    return spark.read.parquet(step_path(keep, step))


def resume_rows(ranked: DataFrame, vector: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Rows to go on from a vector: those of ``ranked`` with its ranks, and an empty one for its other ids."""
    return start_vector(ranked, limits).attach_links(vector)


def matvec(ranked: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """One step on ranked rows; see :func:`matvec_iterate`."""
    return matvec_iterate(ranked, iterations=1, limits=limits)


def matvec_iterate(
    ranked: DataFrame,
    iterations: int | None = None,
    threshold: float | None = None,
    output: str = "rows",
    max_iterations: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    keep: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Repeat the step a number of times, or until no rank moves by more than ``threshold``.

    With neither there is one step; with both, whichever comes first. Zero
    iterations mean "not given". A threshold alone goes on until ranks settle,
    which on a periodic graph they never do; with ``max_iterations`` it stops
    there with :class:`NotSettled`, which has the last vector.

    ``keep`` is a folder that gets every step's vector, see :func:`kept_step`.

    The result has every id with a row or an in-link. An id without in-links
    has rank 0.0, one without a row an empty list. ``output='vector'`` leaves
    the lists out: ``(id, rank)`` instead of ``(src, dst, rank)``.

    Rows from :func:`~adjrank.sources.load_buckets` need no layout: with their
    number of ``buckets`` a loop reads the links from that table in every step,
    without a shuffle of them.

    ``ranked`` is read twice, once for the vertices and once for the links;
    save or checkpoint it first when it is expensive to compute.
    """
    start = start_vector(ranked, limits, buckets)
    vector = iterate(
        start, lambda _: start.lay_out(["dst"]), naive_step, iterations, threshold, max_iterations, opening=_opening, keep=keep
    )
    return finish(start, vector, output)


def _opening(start: StartVector) -> DataFrame:
    """A first step straight from the rows, which carry rank and degree: no join, nothing cached."""
    received = start.ranked.select(
        F.explode("dst").alias("id"), (F.col("rank") / F.greatest(F.size("dst"), F.lit(1))).alias("part")
    )
    return total(known(start.vector), received)


def naive_step(vector: DataFrame, layout: Layout, first: bool) -> DataFrame:
    """One product: ``(id, rank, old)``."""
    sent = layout.sent_by(vector, ["dst"])
    received = sent.select(F.explode("dst").alias("id"), (F.col("rank") / F.col("deg")).alias("part"))
    return total(known(vector), received)


def known(vector: DataFrame) -> DataFrame:
    """What goes along with the contributions: a zero of every id and its rank so far.

    So a single aggregation does the work of a sum, of an outer join, and of
    the join of new with old ranks that the threshold would need.
    """
    return vector.select("id", F.lit(0.0).alias("part"), F.col("rank").alias("old"))


def total(ids: DataFrame, received: DataFrame) -> DataFrame:
    """``(id, rank, old)`` of every id that is known or receives something; ``old`` is null without a rank so far."""
    parts = ids.unionByName(received.withColumn("old", F.lit(None).cast("double")))
    return parts.groupBy("id").agg(F.sum("part").alias("rank"), F.max("old").alias("old"))


def loop_options(iterations: int | None, threshold: float | None) -> tuple[int | None, float | None]:
    """Number of steps (None: until settled) and the threshold to test."""
    if iterations is not None and iterations < 0:
        raise ValueError("iterations must not be negative")
    if threshold is not None and threshold < 0:
        log.warning("a threshold cannot be negative, using zero instead")
        threshold = 0.0
    if not iterations:
        iterations = 1 if threshold is None else None
    return iterations, threshold


def iterate(
    start: StartVector,
    lay_out: Callable[[DataFrame], Layout],
    step: Callable[[DataFrame, Layout, bool], DataFrame],
    iterations: int | None,
    threshold: float | None,
    max_iterations: int | None,
    opening: Callable[[StartVector], DataFrame] | None = None,
    by_ids: bool = False,
    keep: str | None = None,
) -> DataFrame:
    """Run ``step(vector, layout, first)`` until done and return the last vector.

    A step gives ``(id, rank, old)``. Its lineage is cut, and while its rows are
    written, its ids and those that still move are counted: a step is one job,
    with or without a threshold. ``opening`` is a way to take the first
    step without a layout, for rows that are not segmented. ``by_ids`` says
    that the layout depends on the ids of the vector and has to be made again
    when the first step has brought new ones.
    """
    iterations, threshold = loop_options(iterations, threshold)
    vector, layout, done = start.vector.select("id", "rank"), None, 0
    spark = vector.sparkSession
    if start.split_up:
        opening = None
    facts = [F.count("*").alias("ids")]
    if threshold is not None:
        moved = F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0))) > F.lit(float(threshold))
        facts.append(F.count_if(moved).alias("moving"))
    while start.vertices:
        if done == 0 and opening is not None:
            vector, seen = cut_and_measure(opening(start), *facts)
        else:
            layout = layout or lay_out(vector)
            # Large vectors keep their partitioning from step to step.
            with nullcontext() if start.small else static_plans(spark, start.partitions):
                vector, seen = cut_and_measure(step(vector, layout, done == 0), *facts)
        vector, done = vector.drop("old"), done + 1
        if keep is not None:
            vector.select("id", "rank").write.parquet(step_path(keep, done))
        moving = seen.get("moving")
        if moving is not None:
            log.info("step %d: %d ranks still moving", done, moving)
        if moving == 0 or done == iterations:
            break
        if iterations is None and max_iterations is not None and done >= max_iterations:
            raise NotSettled(vector.select("id", "rank"), done, moving)
        if done == 1:
            ids = seen["ids"]
            if layout is not None and by_ids and ids > start.vertices:
                layout = None
            layout = layout or lay_out(vector)
            layout.grown = ids > start.limits.broadcast_rows
    return vector.select("id", "rank")




def finish(start: StartVector, vector: DataFrame, output: str) -> DataFrame:
    if output not in OUTPUTS:
        raise ValueError(f"output must be one of {', '.join(OUTPUTS)}")
    return vector if output == "vector" else start.attach_links(vector)
