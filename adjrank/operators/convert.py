"""Conversions between adjacency rows, edges and rank vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjrank.functions.blocks import integer_div, range_of
from adjrank.operators.position import global_index
from adjrank.operators.skew import GroupSizes, group_sizes, split_heavy
from adjrank.session import DEFAULT_LIMITS, Limits, cut


def attach_rank(adj: DataFrame, value: float = 1.0) -> DataFrame:
    """Give every row the same rank."""
    return adj.withColumn("rank", F.lit(float(value)))


def adjacency_to_edges(adj: DataFrame) -> DataFrame:
    """One row ``(src, dst)`` per link; repeated links stay, rows without links vanish."""
    return adj.select("src", F.explode("dst").alias("dst"))


def edges_to_adjacency(edges: DataFrame, limits: Limits = DEFAULT_LIMITS, total: int | None = None) -> DataFrame:
    """Gather links by source into rows ``(src, segment, dst)``, ascending.

    A vertex is one row, segment 0, unless it has more than ``limits.max_links``
    links; then every ``max_links`` of its sorted list are a segment of their
    own. ``edges`` is read twice, first to count; once if their ``total`` number
    is given and no more than ``limits.max_links``.

    The few vertices with too many links for one task are never gathered: their
    edges are put in order by a range sort and cut into segments by position.
    """
    edges = edges.select("src", "dst")
    return _gather(edges, group_sizes(edges, "src", limits, total), limits)


def _gather(edges: DataFrame, sizes: GroupSizes, limits: Limits) -> DataFrame:
    """Rows of the edges, given the sizes of their groups; a null ``dst`` makes a row, but no link."""
    light = edges
    if sizes.heavy is not None:
        light, many = split_heavy(edges, "src", sizes.heavy)
    rows = light.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dst"))
    if sizes.largest > limits.max_links:
        starts = F.sequence(F.lit(1), F.greatest(F.size("dst"), F.lit(1)), F.lit(limits.max_links))
        pieces = F.transform(starts, lambda at: F.slice("dst", at, F.lit(limits.max_links)))
        rows = rows.select("src", F.posexplode(pieces).alias("segment", "dst"))
    else:
        rows = rows.withColumn("segment", F.lit(0))
    rows = rows.select("src", F.col("segment").cast("bigint").alias("segment"), "dst")
    if sizes.heavy is not None:
        rows = rows.unionByName(_segments(many.where("dst is not null"), limits.max_links))
    return rows


def _segments(edges: DataFrame, max_links: int) -> DataFrame:
    """Rows of at most ``max_links`` links for a few vertices with very many."""
    placed = global_index(edges, [F.asc("src"), F.asc("dst")], unique=False)
    first = placed.groupBy("src").agg(F.min("pos").alias("first"))
    return (
        placed.join(F.broadcast(first), "src")
        .groupBy("src", integer_div(F.col("pos") - F.col("first"), max_links).alias("segment"))
        .agg(F.sort_array(F.collect_list("dst")).alias("dst"))
    )


def split_rows(adj: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Cut every list longer than ``limits.max_links`` into rows that differ in ``segment``.

    For rows that come with one list per vertex, as readers deliver them; nothing is shuffled.
    """
    if "segment" in adj.columns:
        raise ValueError("the rows are split already")
    starts = F.sequence(F.lit(1), F.greatest(F.size("dst"), F.lit(1)), F.lit(limits.max_links))
    pieces = F.transform(starts, lambda at: F.slice("dst", at, F.lit(limits.max_links)))
    others = [name for name in adj.columns if name not in ("src", "dst")]
    return adj.select("src", F.posexplode(pieces).alias("segment", "dst"), *others).withColumn("segment", F.col("segment").cast("bigint"))


def merge_segments(adj: DataFrame) -> DataFrame:
    """One row per vertex again, its segments in order, gathered; writers of text do without.

    Only vertices with several rows are shuffled, and none where there are none.
    """
    if "segment" not in adj.columns:
        return adj
    several = cut(adj.where("segment > 0").select("src").distinct())
    columns = [name for name in adj.columns if name != "segment"]
    if several.isEmpty():
        return adj.select(*columns)
    others = [F.first(name).alias(name) for name in columns if name not in ("src", "dst")]
    parts = F.array_sort(F.collect_list(F.struct("segment", "dst")))
    cut_up = adj.join(several, "src", "left_semi").groupBy("src")
    merged = cut_up.agg(F.flatten(F.transform(parts, lambda x: x["dst"])).alias("dst"), *others)
    return adj.join(several, "src", "left_anti").select(*columns).unionByName(merged)


def transpose(adj: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """In-links: row ``v`` lists every ``u`` with a link to ``v``, once per link.

    Only vertices with an in-link have a row; long lists are split into
    segments as in :func:`edges_to_adjacency`.
    """
    return edges_to_adjacency(adj.select(F.explode("dst").alias("src"), F.col("src").alias("dst")), limits)


def out_degree(adj: DataFrame) -> DataFrame:
    """``(src, degree)``: the number of links kept per vertex."""
    if "segment" in adj.columns:
        return adj.groupBy("src").agg(F.sum(F.size("dst")).alias("degree"))
    return adj.select("src", F.size("dst").cast("bigint").alias("degree"))


def rank_vector(ranked: DataFrame) -> DataFrame:
    """``(id, rank)`` of ranked rows; the rows of one vertex carry the same rank."""
    if "segment" in ranked.columns:
        return ranked.groupBy(F.col("src").alias("id")).agg(F.max("rank").alias("rank"))
    return ranked.select(F.col("src").alias("id"), "rank")


def ranked_from_decoded(
    edges: DataFrame, n_vertices: int, n_splits: int, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Ranked rows ``(src, segment, dst, rank, split)`` for every vertex of ``[0, n_vertices)``.

    Vertices without a link get an empty row; the rank is 1.0 and ``split`` the
    contiguous vertex range the row belongs to. Edges that start outside of the
    range are an error, found by the pass that counts; ``edges`` is read twice.
    """
    spark = edges.sparkSession
    ids = spark.range(n_vertices).select(F.col("id").alias("src"), F.lit(None).cast("bigint").alias("dst"))
    # A link to nowhere gives every vertex its row; lists leave it out.
    linked = edges.select("src", "dst").where("dst is not null").unionByName(ids)
    outside = ~F.col("src").between(0, n_vertices - 1)
    sizes = group_sizes(linked, "src", limits, facts=[F.sum(F.when(outside, F.col("n"))).alias("outside")])
    if sizes.facts["outside"]:
        raise ValueError(f"{sizes.facts['outside']} edges start outside of the {n_vertices} vertices")
    return attach_rank(_gather(linked, sizes, limits)).withColumn("split", range_of(F.col("src"), n_vertices, n_splits))
