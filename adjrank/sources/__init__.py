"""Readers, writers and the synthetic graph source."""

from adjrank.sources.generator import generate_blocked_graph
from adjrank.sources.tables import load_buckets, load_graph, load_split, save_buckets, save_graph
from adjrank.sources.text import (
    read_adjacency,
    read_rank_vector,
    read_ranked_adjacency,
    write_adjacency,
    write_edges,
    write_pairs,
    write_rank_vector,
    write_ranked_adjacency,
)

__all__ = [
    "generate_blocked_graph",
    "load_buckets",
    "load_graph",
    "load_split",
    "read_adjacency",
    "read_rank_vector",
    "read_ranked_adjacency",
    "save_buckets",
    "save_graph",
    "write_adjacency",
    "write_edges",
    "write_pairs",
    "write_rank_vector",
    "write_ranked_adjacency",
]
