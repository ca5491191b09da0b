"""Operators: plain functions from DataFrames to a DataFrame."""

from adjrank.operators.block_product import partitioned_matvec, partitioned_matvec_iterate
from adjrank.operators.blocks import assign_blocks, classify_edges, vertex_ranges
from adjrank.operators.compare import max_rank_difference, rank_deltas, unconverged_count
from adjrank.operators.convert import (
    adjacency_to_edges,
    attach_rank,
    edges_to_adjacency,
    merge_segments,
    out_degree,
    rank_vector,
    ranked_from_decoded,
    split_rows,
    transpose,
)
from adjrank.operators.product import NotSettled, kept_step, matvec, matvec_iterate, resume_rows
from adjrank.operators.order import pair_adjacent, sort_by_rank
from adjrank.operators.placement import spread_evenly
from adjrank.operators.position import global_index, load_positions, number_rows, save_sorted

__all__ = [
    "NotSettled",
    "adjacency_to_edges",
    "assign_blocks",
    "attach_rank",
    "classify_edges",
    "edges_to_adjacency",
    "global_index",
    "kept_step",
    "load_positions",
    "matvec",
    "matvec_iterate",
    "max_rank_difference",
    "merge_segments",
    "number_rows",
    "out_degree",
    "pair_adjacent",
    "partitioned_matvec",
    "partitioned_matvec_iterate",
    "rank_deltas",
    "rank_vector",
    "ranked_from_decoded",
    "resume_rows",
    "save_sorted",
    "sort_by_rank",
    "split_rows",
    "spread_evenly",
    "transpose",
    "unconverged_count",
    "vertex_ranges",
]
