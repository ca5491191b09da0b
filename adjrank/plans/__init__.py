"""End-to-end pipelines."""

from adjrank.plans.apps import inner_outer_nsd, naive_nsd, partitioned_nsd, self_match

__all__ = ["inner_outer_nsd", "naive_nsd", "partitioned_nsd", "self_match"]
