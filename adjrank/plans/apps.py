"""The applications: iterate a product, then sort the vertices by rank.

``digits`` rounds the ranks before they are ordered. Sums of floating-point
numbers depend on their order in the last bits, so equal exact ranks only tie
after rounding; without it the order among them may change from run to run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjrank.operators.block_product import partitioned_matvec_iterate
from adjrank.operators.product import matvec_iterate
from adjrank.operators.order import pair_adjacent, sort_by_rank
from adjrank.session import DEFAULT_LIMITS, Limits


def _ordered(vector: DataFrame, match: bool, digits: int | None) -> DataFrame:
    if digits is not None:
        vector = vector.withColumn("rank", F.round("rank", digits))
    return pair_adjacent(vector) if match else sort_by_rank(vector)


def naive_nsd(
    graph: DataFrame,
    iterations: int,
    match: bool = False,
    digits: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Ranks after ``iterations`` products, sorted; with ``match`` the pairs of neighbours."""
    vector = matvec_iterate(graph, iterations, output="vector", limits=limits)
    return _ordered(vector, match, digits)


def partitioned_nsd(
    graph: DataFrame,
    block_size: int,
    iterations: int,
    match: bool = False,
    digits: int | None = None,
    by: str = "range",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """The same with block steps of one local pass."""
    return inner_outer_nsd(graph, block_size, iterations, 1, match, digits, by, limits)


def inner_outer_nsd(
    graph: DataFrame,
    block_size: int,
    outer: int,
    inner: int,
    match: bool = False,
    digits: int | None = None,
    by: str = "range",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """The same with ``outer`` block steps of ``inner`` local passes each."""
    vector = partitioned_matvec_iterate(
        graph, block_size, outer=outer, inner=inner, by=by, output="vector", limits=limits
    )
    return _ordered(vector, match, digits)


def self_match(
    graph: DataFrame,
    iterations: int,
    block_size: int | None = None,
    inner: int = 1,
    digits: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Pairs of neighbours in rank order, after products or (given a block size) block steps."""
    if block_size is None:
        return naive_nsd(graph, iterations, match=True, digits=digits, limits=limits)
    return inner_outer_nsd(
        graph, block_size, iterations, inner, match=True, digits=digits, limits=limits
    )
