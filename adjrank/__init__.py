"""Analysis of large directed graphs held as adjacency tables, on Spark DataFrames."""

from adjrank.functions import range_of
from adjrank.operators import *  # noqa: F403
from adjrank.operators import __all__ as _operators
from adjrank.plans import inner_outer_nsd, naive_nsd, partitioned_nsd, self_match
from adjrank.session import DEFAULT_LIMITS, Limits
from adjrank.sources import *  # noqa: F403
from adjrank.sources import __all__ as _sources

__all__ = [
    "DEFAULT_LIMITS",
    "Limits",
    "inner_outer_nsd",
    "naive_nsd",
    "partitioned_nsd",
    "range_of",
    "self_match",
    *_operators,
    *_sources,
]
