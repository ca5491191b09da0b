"""

Every query derives its graph from the given tables. Arrays are returned as
joined strings and ranks rounded to nine places, so that both engines hash
alike.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import adjrank as ar  # noqa: E402
from adjrank.functions import adjacency_line, block_of  # noqa: E402
from adjrank.plans.order_graphs import (  # noqa: E402
    basket_edges,
    basket_rows,
    mixed_edges,
    part_id,
    ranked_rows,
    supply_edges,
)
from adjrank.session import scratch_path, stored  # noqa: E402

DIGITS = 9
BLOCK = 256
# Few vertices, so that there are many blocks for each partition of a small session.
NARROW_BLOCK = 8
WIDE_BLOCK = 512
GENERATOR = {"degree": 5, "border_ratio": 0.3, "block_size": 128, "seed": 42}
SPLITS = 7
BUCKETS = 6
# Small limits that send test-sized graphs down the ways meant for large ones.
TIGHT = ar.Limits(max_links=100, broadcast_rows=500)
UNTIL = {"threshold": 0.02}
BLOCKED_UNTIL = {"threshold": 0.05}
MOVED = 0.1
TOP = 25


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _lineitem(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "lineitem")


def _basket(spark, sf_dir) -> DataFrame:
    return basket_rows(_lineitem(spark, sf_dir))


def _basket_lists(spark, sf_dir) -> DataFrame:
    """Basket rows with a rank that differs between vertices and prints alike everywhere."""
    rows = ar.edges_to_adjacency(stored(basket_edges(_lineitem(spark, sf_dir)), "edges"))
    return rows.withColumn("rank", F.size("dst") / F.lit(4.0))


def _supply(spark, sf_dir, both_ways=False, limits=ar.DEFAULT_LIMITS) -> DataFrame:
    return ranked_rows(supply_edges(_lineitem(spark, sf_dir), both_ways), limits)


def _gappy(spark, sf_dir, limits=ar.DEFAULT_LIMITS) -> DataFrame:
    """Baskets and suppliers in one graph; suppliers, every other id, have no row."""
    return ranked_rows(mixed_edges(_lineitem(spark, sf_dir)), limits)


def _hubs(spark, sf_dir) -> DataFrame:
    """Rows in segments: suppliers have more links than one row may hold here."""
    return _supply(spark, sf_dir, both_ways=True, limits=TIGHT)


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with their list as a string."""
    return rows.select(
        "src",
        F.size("dst").cast("bigint").alias("n_links"),
        F.concat_ws(" ", F.col("dst").cast("array<string>")).alias("links"),
        *columns,
    )


def _rounded(vector: DataFrame) -> DataFrame:
    return vector.select("id", F.round("rank", DIGITS).alias("rank"))


def _step_1(spark, sf_dir) -> DataFrame:
    return _rounded(ar.matvec_iterate(_basket(spark, sf_dir), 1, output="vector"))


# --- sources and sinks -------------------------------------------------------


def read_ranked_adjacency(spark, sf_dir):
    """Good lines and seven kinds of odd ones, written as text and read back."""
    rows = _basket_lists(spark, sf_dir).select("src", "dst", "rank", F.size("dst").alias("n"))
    src, n, rank = F.col("src"), F.col("n"), F.col("rank")
    links = F.concat_ws(" ", F.col("dst").cast("array<string>"))
    rest = F.concat_ws(" ", F.slice("dst", F.lit(2), F.col("n")).cast("array<string>"))
    kind = src % 8
    line = (
        F.when(kind == 0, F.concat_ws(" ", src, n, links, rank))
        .when(kind == 1, F.concat_ws(" ", src, n + 1, links, rank))
        .when(kind == 2, F.concat_ws(" ", src, n + 2, links, rank))
        .when(kind == 3, F.concat_ws(" ", src, n - 1, links, rank))
        .when(kind == 4, F.concat_ws(" ", src, n, F.get("dst", F.lit(0)), F.lit("y"), rest, rank))
        .when(kind == 5, F.concat_ws(" ", F.lit("x"), src, n, links, rank))
        .when(kind == 6, F.concat_ws(" ", src, n, links, F.lit("oops")))
        .otherwise(F.concat_ws(" ", src, F.lit(0), rank))
    )
    path = scratch_path(spark, "ranked-lines")
    rows.select(line.alias("value")).write.text(path)
    return _listed(ar.read_ranked_adjacency(spark, path), "rank")


def read_adjacency(spark, sf_dir):
    """Keyed lines without rank; a line one link short loses its last one."""
    rows = _basket_lists(spark, sf_dir).select("src", "dst", F.size("dst").alias("n"))
    src, n, links = F.col("src"), F.col("n"), F.concat_ws(" ", F.col("dst").cast("array<string>"))
    kind = src % 4
    line = (
        F.when(kind == 0, F.concat_ws(" ", src, n, links))
        .when(kind == 1, F.concat_ws(" ", src, n + 1, links))
        .when(kind == 2, F.concat(F.concat_ws(" ", src, n, links), F.lit("  ")))
        .otherwise(F.concat_ws(" ", src, F.lit(-1), links))
    )
    path = scratch_path(spark, "keyed-lines")
    rows.select(F.concat_ws("\t", src % 10, line).alias("value")).write.text(path)
    return _listed(ar.read_adjacency(spark, path, keyed=True))


def read_rank_vector(spark, sf_dir):
    rows = ar.rank_vector(_basket_lists(spark, sf_dir))
    kind = F.col("id") % 5
    line = (
        F.when(kind == 3, F.concat_ws("\t", F.lit("vertex"), "id", "rank"))
        .when(kind == 4, F.concat_ws("  ", F.lit(""), "id", "rank", F.lit("more")))
        .otherwise(F.concat_ws("\t", "id", "rank"))
    )
    path = scratch_path(spark, "vector-lines")
    rows.select(line.alias("value")).write.text(path)
    return ar.read_rank_vector(spark, path)


def graph_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "graph")
    ar.save_graph(_basket_lists(spark, sf_dir), path)
    return _listed(ar.load_graph(spark, path), "segment", "rank")


def read_range(spark, sf_dir):
    """The fourth of seven ranges of the supply graph's vertices, read alone from a clustered graph."""
    path, n = scratch_path(spark, "clustered"), 2 * _table(spark, sf_dir, "part").count()
    ar.save_graph(_supply(spark, sf_dir, both_ways=True), path, clustered=True)
    return _listed(ar.load_split(spark, path, n, SPLITS, 3), "segment", "rank")


def graph_roundtrip_segments(spark, sf_dir):
    """A step on a stored graph whose hubs have several rows."""
    path = scratch_path(spark, "graph")
    ar.save_graph(_hubs(spark, sf_dir), path)
    return _rounded(ar.matvec_iterate(ar.load_graph(spark, path), 1, output="vector"))


def text_roundtrip_segments(spark, sf_dir):
    """The same through text, where a vertex is one line, split again into rows."""
    path = scratch_path(spark, "lines")
    ar.write_ranked_adjacency(_hubs(spark, sf_dir), path)
    rows = ar.split_rows(ar.read_ranked_adjacency(spark, path), TIGHT)
    return _rounded(ar.matvec_iterate(rows, 1, output="vector", limits=TIGHT))


def split_rows(spark, sf_dir):
    """Lists of suppliers cut into rows of at most 100 links."""
    whole = ar.edges_to_adjacency(supply_edges(_lineitem(spark, sf_dir), both_ways=True))
    return _listed(ar.split_rows(ar.merge_segments(whole), TIGHT), "segment")


def format_ranked_adjacency(spark, sf_dir):
    path = scratch_path(spark, "formatted")
    ar.write_ranked_adjacency(_basket_lists(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def format_adjacency(spark, sf_dir):
    rows = _basket_lists(spark, sf_dir)
    return rows.select(adjacency_line(F.col("src"), F.col("dst")).alias("line"))


def write_edges(spark, sf_dir):
    path = scratch_path(spark, "edges")
    ar.write_edges(supply_edges(_lineitem(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def write_rank_vector(spark, sf_dir):
    path = scratch_path(spark, "vector")
    ar.write_rank_vector(_step_1(spark, sf_dir), path)
    return ar.read_rank_vector(spark, path)


def write_pairs(spark, sf_dir):
    path = scratch_path(spark, "pairs")
    ar.write_pairs(ar.pair_adjacent(_step_1(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def generate_blocked_graph(spark, sf_dir):
    """A graph with as many vertices as there are orders."""
    n = _table(spark, sf_dir, "orders").count()
    return _listed(ar.generate_blocked_graph(spark, n, **GENERATOR), "rank")


def ranked_from_decoded(spark, sf_dir):
    """Parts and their suppliers; the odd ids have no links."""
    edges = supply_edges(_lineitem(spark, sf_dir))
    n = 2 * _table(spark, sf_dir, "part").count()
    return _listed(ar.ranked_from_decoded(stored(edges, "edges"), n, SPLITS), "segment", "rank", "split")


# --- conversions -------------------------------------------------------------


def attach_rank(spark, sf_dir):
    adj = ar.edges_to_adjacency(supply_edges(_lineitem(spark, sf_dir)))
    return _listed(ar.attach_rank(adj, 2.5), "rank")


def adjacency_to_edges(spark, sf_dir):
    return ar.adjacency_to_edges(_supply(spark, sf_dir))


def edges_to_adjacency(spark, sf_dir):
    return _listed(ar.edges_to_adjacency(supply_edges(_lineitem(spark, sf_dir))), "segment")


def transpose(spark, sf_dir):
    return _listed(ar.transpose(_basket(spark, sf_dir)), "segment")


def transpose_segments(spark, sf_dir):
    """Suppliers have more in-links than one row may hold here."""
    return _listed(ar.transpose(_supply(spark, sf_dir), TIGHT), "segment")


def out_degree(spark, sf_dir):
    return ar.out_degree(_supply(spark, sf_dir, both_ways=True, limits=TIGHT))


def rank_vector(spark, sf_dir):
    return ar.rank_vector(_basket_lists(spark, sf_dir))


# --- ranges, blocks, local edges ---------------------------------------------


def vertex_ranges(spark, sf_dir):
    """Parts cut into as many ranges as there are suppliers, with the order lines of each."""
    n, splits = (_table(spark, sf_dir, name).count() for name in ("part", "supplier"))
    ranges = ar.vertex_ranges(spark, n, splits)
    lines = _lineitem(spark, sf_dir).groupBy(ar.range_of(F.col("l_partkey"), n, splits).alias("split")).agg(F.count("*").alias("lines"))
    return ranges.join(lines, "split", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


def range_of(spark, sf_dir):
    """Lines per range of part numbers; the upper half of the parts is outside."""
    n = _table(spark, sf_dir, "part").count() // 2
    split = ar.range_of(F.col("l_partkey"), n, SPLITS).alias("split")
    return _lineitem(spark, sf_dir).groupBy(split).agg(F.count("*").alias("lines"))


def assign_blocks(spark, sf_dir):
    return ar.assign_blocks(_gappy(spark, sf_dir), BLOCK, co_locate=True).select("src", "block_id")


def assign_blocks_position(spark, sf_dir):
    return ar.assign_blocks(_gappy(spark, sf_dir), BLOCK, by="position").select("src", "block_id")


def classify_edges(spark, sf_dir):
    rows = _gappy(spark, sf_dir)
    return ar.classify_edges(ar.adjacency_to_edges(rows), ar.assign_blocks(rows, BLOCK))


def classify_edges_heavy(spark, sf_dir):
    """Repeated edges to suppliers with more in-links than one task may hold."""
    rows = _supply(spark, sf_dir, both_ways=True)
    blocks = rows.select("src", block_of(F.col("src"), WIDE_BLOCK).alias("block_id"))
    return ar.classify_edges(ar.adjacency_to_edges(rows), blocks, TIGHT)


# --- products ----------------------------------------------------------------


def _naive(steps: int, limits=ar.DEFAULT_LIMITS):
    def run(spark, sf_dir):
        return _rounded(ar.matvec_iterate(_basket(spark, sf_dir), steps, output="vector", limits=limits))

    return run


def matvec_rows(spark, sf_dir):
    """One step with the lists attached; suppliers have no row and get an empty list."""
    rows = ar.matvec(_supply(spark, sf_dir))
    return _listed(rows, F.round("rank", DIGITS).alias("rank"))


def matvec_resumed(spark, sf_dir):
    """Two steps that are kept, and a third one from the second's vector."""
    rows, keep = _basket(spark, sf_dir), scratch_path(spark, "steps")
    ar.matvec_iterate(rows, 2, output="vector", keep=keep)
    onward = ar.resume_rows(rows, ar.kept_step(spark, keep, 2))
    return _rounded(ar.matvec_iterate(onward, 1, output="vector"))


def matvec_bucketed(spark, sf_dir):
    """Three steps over a stored table in buckets by vertex, which no step shuffles."""
    table = f"baskets_{uuid.uuid4().hex}"
    ar.save_buckets(_basket(spark, sf_dir), table, scratch_path(spark, table), BUCKETS)
    rows = ar.load_buckets(spark, table)
    return _rounded(ar.matvec_iterate(rows, 3, output="vector", limits=TIGHT, buckets=BUCKETS))


def matvec_dangling(spark, sf_dir):
    rows = ranked_rows(supply_edges(_lineitem(spark, sf_dir)).distinct())
    return _rounded(ar.matvec_iterate(rows, 1, output="vector"))


def matvec_multilink(spark, sf_dir):
    rows = _supply(spark, sf_dir, both_ways=True)
    return _rounded(ar.matvec_iterate(rows, 2, output="vector"))


def matvec_heavy(spark, sf_dir):
    """The same graph with segmented rows, heavy vertices and a shuffled vector."""
    rows = _supply(spark, sf_dir, both_ways=True, limits=TIGHT)
    return _rounded(ar.matvec_iterate(rows, 2, output="vector", limits=TIGHT))


def matvec_until(spark, sf_dir):
    return _rounded(ar.matvec_iterate(_basket(spark, sf_dir), output="vector", **UNTIL))


def unconverged_count(spark, sf_dir):
    rows = _basket(spark, sf_dir)
    new = ar.matvec_iterate(rows, 1, output="vector")
    return ar.unconverged_count(ar.rank_vector(rows), new, MOVED)


def _blocked(steps: int, inner: int, limits=ar.DEFAULT_LIMITS):
    def run(spark, sf_dir):
        rows = _basket(spark, sf_dir)
        return _rounded(
            ar.partitioned_matvec_iterate(rows, BLOCK, steps, inner, output="vector", limits=limits)
        )

    return run


def partitioned_matvec_dangling(spark, sf_dir):
    """One block spans parts and suppliers, but suppliers have no row."""
    rows = _supply(spark, sf_dir)
    return _rounded(ar.partitioned_matvec_iterate(rows, WIDE_BLOCK, 1, 2, output="vector"))


def partitioned_matvec_position(spark, sf_dir):
    """Blocks by position, which shift when vertices gain a row after the first step."""
    rows = _gappy(spark, sf_dir)
    return _rounded(ar.partitioned_matvec_iterate(rows, BLOCK, 2, 2, by="position", output="vector"))


def partitioned_matvec_gappy(spark, sf_dir):
    rows = _gappy(spark, sf_dir)
    return _rounded(ar.partitioned_matvec_iterate(rows, BLOCK, 2, 2, output="vector", limits=TIGHT))


def partitioned_matvec_position_shuffled(spark, sf_dir):
    """Blocks by position with small limits: nothing that grows with the ids may be broadcast."""
    rows = _gappy(spark, sf_dir, TIGHT)
    return _rounded(ar.partitioned_matvec_iterate(rows, BLOCK, 2, 2, by="position", output="vector", limits=TIGHT))


def partitioned_matvec_co_located(spark, sf_dir):
    """Many small blocks, so that whole blocks are hashed to partitions."""
    rows = _basket(spark, sf_dir)
    return _rounded(ar.partitioned_matvec_iterate(rows, NARROW_BLOCK, 2, 2, output="vector", limits=TIGHT))


def partitioned_matvec_co_located_heavy(spark, sf_dir):
    """The same with suppliers too large for one task."""
    rows = _hubs(spark, sf_dir)
    return _rounded(ar.partitioned_matvec_iterate(rows, NARROW_BLOCK, 2, 2, output="vector", limits=TIGHT))


def partitioned_matvec_until(spark, sf_dir):
    """Block steps until no rank moves by more than the threshold."""
    rows = _basket(spark, sf_dir)
    return _rounded(ar.partitioned_matvec_iterate(rows, BLOCK, inner=1, output="vector", **BLOCKED_UNTIL))


# --- comparison --------------------------------------------------------------


def _two_vectors(spark, sf_dir):
    """Ranks along baskets, and along lines to suppliers, which only this vector has."""
    along_baskets = ar.matvec_iterate(_basket(spark, sf_dir), 1, output="vector")
    along_baskets = along_baskets.withColumn("id", part_id(F.col("id")))
    return along_baskets, ar.matvec_iterate(_supply(spark, sf_dir, both_ways=True), 2, output="vector")


def rank_deltas(spark, sf_dir):
    deltas = ar.rank_deltas(*_two_vectors(spark, sf_dir))
    return deltas.select("id", F.round("delta", DIGITS).alias("delta"))


def max_rank_difference(spark, sf_dir):
    largest = ar.max_rank_difference(*_two_vectors(spark, sf_dir))
    return largest.select(F.round("max_delta", DIGITS).alias("max_delta"))


# --- order, matching, applications ---------------------------------------------


# Sorted results have the place at which each row came, so that their order is compared as well.


def sort_by_rank(spark, sf_dir):
    return ar.number_rows(ar.sort_by_rank(_step_1(spark, sf_dir)))


def top_k_by_rank(spark, sf_dir):
    return ar.number_rows(ar.sort_by_rank(_step_1(spark, sf_dir), limit=TOP))


def rank_position(spark, sf_dir):
    return ar.global_index(_step_1(spark, sf_dir))


def pair_adjacent(spark, sf_dir):
    return ar.pair_adjacent(_step_1(spark, sf_dir))


def pair_adjacent_stored(spark, sf_dir):
    """The same on a stored order, which is not sorted again."""
    path = scratch_path(spark, "sorted")
    ar.save_sorted(_step_1(spark, sf_dir), path)
    return ar.pair_adjacent(ar.load_positions(spark, path))


def naive_nsd(spark, sf_dir):
    return ar.number_rows(ar.naive_nsd(_basket(spark, sf_dir), 3, digits=DIGITS))


def partitioned_nsd(spark, sf_dir):
    return ar.number_rows(ar.partitioned_nsd(_basket(spark, sf_dir), BLOCK, 2, digits=DIGITS))


def inner_outer_nsd(spark, sf_dir):
    return ar.number_rows(ar.inner_outer_nsd(_basket(spark, sf_dir), BLOCK, 2, 2, digits=DIGITS))


def self_match(spark, sf_dir):
    return ar.self_match(_basket(spark, sf_dir), 3, digits=DIGITS)


def self_match_blocked(spark, sf_dir):
    return ar.self_match(_basket(spark, sf_dir), 2, block_size=BLOCK, inner=2, digits=DIGITS)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: three products on the basket graph, vertices sorted by rank."""
    return naive_nsd(spark, "/root/testdata/sf0.001")


def _optional():
    """Modules with the queries on training text and the pipeline over them; none if they are not there."""
    try:
        import corpus_pipeline
        from adjrank.llm import queries as texts
    except ImportError:
        return None, None
    return texts, corpus_pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query; each takes the session and a table folder."""
    texts, pipeline = _optional()
    return graph_queries() | ({**texts.queries(), "pipeline": pipeline.run} if texts else {})


def graph_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per graph operator."""
    plain = [
        read_ranked_adjacency, read_adjacency, read_rank_vector, graph_roundtrip, read_range,
        graph_roundtrip_segments, text_roundtrip_segments, split_rows,
        format_ranked_adjacency, format_adjacency, write_edges, write_rank_vector, write_pairs,
        generate_blocked_graph, ranked_from_decoded,
        attach_rank, adjacency_to_edges, edges_to_adjacency, transpose, transpose_segments,
        out_degree, rank_vector,
        vertex_ranges, range_of, assign_blocks, assign_blocks_position,
        classify_edges, classify_edges_heavy,
        matvec_rows, matvec_resumed, matvec_bucketed, matvec_dangling, matvec_multilink, matvec_heavy, matvec_until, unconverged_count,
        partitioned_matvec_dangling, partitioned_matvec_position, partitioned_matvec_gappy,
        partitioned_matvec_position_shuffled, partitioned_matvec_co_located, partitioned_matvec_co_located_heavy,
        partitioned_matvec_until,
        rank_deltas, max_rank_difference,
        sort_by_rank, top_k_by_rank, rank_position, pair_adjacent, pair_adjacent_stored,
        naive_nsd, partitioned_nsd, inner_outer_nsd, self_match, self_match_blocked,
    ]
    return {
        **{query.__name__: query for query in plain},
        "matvec_1": _naive(1),
        "matvec_3": _naive(3),
        "matvec_3_shuffled": _naive(3, TIGHT),
        "partitioned_matvec_1": _blocked(1, 1),
        "partitioned_matvec_inner2": _blocked(1, 2),
        "partitioned_matvec_iter": _blocked(3, 2),
        "partitioned_matvec_shuffled": _blocked(2, 2, TIGHT),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same result for every query that SQL can express."""
    import adjrank_oracle

    texts, pipeline = _optional()
    own = {**texts.oracle_sql(), "pipeline": pipeline.ORACLE_SQL} if texts else {}
    return adjrank_oracle.statements() | {name: sql for name, sql in own.items() if sql}
