"""What must not change when tables grow: numbering, draws, segments, bounds of broadcasts."""

import pytest
from pyspark.sql import functions as F

import adjrank as ar
from adjrank.functions.draws import with_distinct_draws, with_streams
from adjrank.operators.layout import start_vector
from adjrank.operators.block_product import _split_links
from adjrank.plans.order_graphs import mixed_edges, supply_edges
from adjrank.session import Limits

LINES = "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_shipdate date, l_extendedprice double"
HUB = Limits(max_links=100, broadcast_rows=100)


def hub_edges(spark, n=250):
    return spark.range(1, n + 1).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))


def test_parts_and_suppliers_never_share_a_vertex(spark):
    keys = [0, 1, 2, 999_999, 1_000_000, 1_000_001, 2_000_001, 1 << 40]
    lines = spark.createDataFrame([(i, 1, p, s, None, 1.0) for i, (p, s) in enumerate((p, s) for p in keys for s in keys)], LINES)
    edges = supply_edges(lines).collect()
    assert len({e.src for e in edges}) == len(keys) == len({e.dst for e in edges})
    assert not {e.src for e in edges} & {e.dst for e in edges}
    assert {e.src % 2 for e in mixed_edges(lines).collect()} == {0}


@pytest.mark.parametrize("choices", [5, 1 << 24, (1 << 24) + 1, 1 << 33])
def test_draws_are_distinct_and_even_for_any_number_of_choices(spark, choices):
    df = with_streams(spark.range(400), F.col("id"), 7, ["s"])
    df = with_distinct_draws(df, "picks", F.col("id"), F.col("s"), F.lit(20).cast("bigint"), F.lit(choices).cast("bigint"))
    rows = [r.picks for r in df.collect()]
    assert all(len(set(r)) == len(r) == min(20, choices) and 0 <= min(r) and max(r) < choices for r in rows)
    mean = sum(sum(r) / len(r) for r in rows) / len(rows)
    assert abs(mean / (choices - 1) - 0.5) < 0.03


def test_vertices_with_equal_streams_draw_differently(spark):
    df = spark.range(50).withColumn("s", F.lit(12345).cast("bigint"))
    df = with_distinct_draws(df, "picks", F.col("id"), F.col("s"), F.lit(3).cast("bigint"), F.lit(1 << 40).cast("bigint"))
    assert len({tuple(r.picks) for r in df.collect()}) == 50


def test_edges_outside_of_the_vertices_are_an_error(spark):
    edges = spark.createDataFrame([(0, 1), (5, 0), (7, 1)], "src bigint, dst bigint")
    with pytest.raises(ValueError, match="2 edges"):
        ar.ranked_from_decoded(edges, 5, 2)


def test_steps_after_the_last_are_not_lost(spark, tmp_path):
    ring = spark.createDataFrame([(0, [1], 1.0), (1, [0], 3.0)], "src bigint, dst array<bigint>, rank double")
    with pytest.raises(ar.NotSettled) as stopped:
        ar.matvec_iterate(ring, threshold=0.5, max_iterations=3, keep=str(tmp_path / "k"))
    assert stopped.value.steps == 3
    last = {r.id: r["rank"] for r in stopped.value.vector.collect()}
    assert last == {0: 3.0, 1: 1.0} == {r.id: r["rank"] for r in ar.kept_step(spark, str(tmp_path / "k"), 3).collect()}
    assert {r.id: r["rank"] for r in ar.kept_step(spark, str(tmp_path / "k"), 2).collect()} == {0: 1.0, 1: 3.0}


def test_a_threshold_alone_goes_on_until_ranks_settle(spark):
    # a chain of ten loses its last rank in step ten
    chain = spark.range(10).select(F.col("id").alias("src"), F.array(F.col("id") + 1).alias("dst"), F.lit(1.0).alias("rank"))
    assert ar.matvec_iterate(chain, threshold=0.0, output="vector").agg(F.sum("rank")).first()[0] == 0.0


def test_segments_survive_storage_and_text(spark, tmp_path):
    rows = ar.attach_rank(ar.edges_to_adjacency(hub_edges(spark), HUB))
    assert rows.count() == 3
    ar.save_graph(rows, str(tmp_path / "g"))
    stored = ar.load_graph(spark, str(tmp_path / "g"))
    assert "segment" in stored.columns and ar.out_degree(stored).collect() == [(0, 250)]
    assert ar.rank_vector(stored).count() == 1
    ar.write_ranked_adjacency(rows, str(tmp_path / "t"))
    lines = ar.read_ranked_adjacency(spark, str(tmp_path / "t"))
    assert lines.count() == 1 and ar.matvec(lines).count() == 251
    again = ar.split_rows(lines, HUB)
    key = lambda r: r.segment
    assert [(r.segment, r.dst) for r in sorted(again.collect(), key=key)] == [(r.segment, r.dst) for r in sorted(rows.collect(), key=key)]
    with pytest.raises(ValueError, match="split already"):
        ar.split_rows(again)


def test_classify_edges_with_repeated_rows(spark):
    rows = ar.edges_to_adjacency(hub_edges(spark), HUB)
    blocks = ar.assign_blocks(rows, 64).drop("segment")
    found = ar.classify_edges(ar.adjacency_to_edges(rows), blocks)
    assert found.count() == 250 and found.where("is_local").count() == 0
    two = blocks.unionByName(blocks.withColumn("block_id", F.lit(9).cast("bigint")))
    with pytest.raises(Exception, match="two blocks for vertex 0"):
        ar.classify_edges(ar.adjacency_to_edges(rows), two).collect()


def test_bounds_of_ids_without_a_row_are_not_broadcast(spark):
    # five rows with long lists reach far more ids than may be broadcast
    rows = spark.range(5).select("id", F.explode(F.sequence(F.col("id") * 1000 + 10, F.col("id") * 1000 + 1009)).alias("dst"))
    rows = ar.attach_rank(ar.edges_to_adjacency(rows.withColumnRenamed("id", "src")))
    limits = Limits(broadcast_rows=10)
    start = start_vector(rows, limits)
    ids = ar.matvec_iterate(rows, 1, output="vector", limits=limits)
    assert ids.count() > 1000
    sent = []

    def own(facts):
        sent.append(facts)
        return facts

    original = F.broadcast
    try:
        F.broadcast = lambda df: sent.append(df) or original(df)
        start.lay_out(["near", "far"], lambda part, facts: _split_links(64, "position", ids, part, facts))
    finally:
        F.broadcast = original
    # a partition's offset is a row as well
    assert sent and max(df.count() for df in sent) <= max(10, spark.sparkContext.defaultParallelism)


def test_unsplit_rows_with_a_segment_column_take_the_short_way(spark):
    rows = ar.attach_rank(ar.edges_to_adjacency(hub_edges(spark, 20)))
    assert not start_vector(rows, Limits()).split_up
    assert start_vector(ar.attach_rank(ar.edges_to_adjacency(hub_edges(spark), HUB)), HUB).split_up


def test_partitions_follow_the_links(spark):
    rows = ar.attach_rank(ar.edges_to_adjacency(hub_edges(spark, 200)))
    assert start_vector(rows, Limits(task_links=10)).partitions == 20
    two = ar.matvec_iterate(rows, 2, output="vector", limits=Limits(task_links=10, broadcast_rows=1, max_links=1000))
    assert two.count() == 201
