"""The plans that matter at scale: shuffles, broadcasts and scans."""

import os
import uuid
from functools import partial

import pytest
from pyspark.sql import functions as F

from adjrank import (
    Limits, assign_blocks, attach_rank, edges_to_adjacency, generate_blocked_graph, load_buckets, load_graph, load_positions,
    matvec_iterate, max_rank_difference, merge_segments, pair_adjacent, rank_vector, save_buckets, save_graph, save_sorted,
    sort_by_rank, spread_evenly, transpose,
)
from adjrank.functions import block_of
from adjrank.operators.block_product import local_ranks, _split_links, block_step
from adjrank.operators.layout import start_vector
from adjrank.operators.placement import partition_keys
from adjrank.operators.product import _opening, naive_step
from adjrank.plans.order_graphs import supply_edges
from adjrank.session import cut, ensure_checkpoint_dir, static_plans

SMALLEST = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    """Shuffles of a plan."""
    kinds = ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange shufflepartitionidpassthrough")
    return [line for line in plan.splitlines() if any(kind in line for kind in kinds)]


def scans(plan):
    """Reads of stored links."""
    return [line for line in plan.splitlines() if "FileScan parquet" in line]


@pytest.fixture(scope="module")
def graph(spark):
    return cut(generate_blocked_graph(spark, 2000, 6, 0.3, 100, seed=2))


def with_hub(spark, graph):
    """The graph and a vertex with 2000 links in segments of 100."""
    hub = spark.range(2000).select(F.lit(5000).cast("bigint").alias("src"), F.col("id").alias("dst"))
    rows = attach_rank(edges_to_adjacency(hub, Limits(max_links=100, broadcast_rows=100)))
    return cut(graph.withColumn("segment", F.lit(0).cast("bigint")).unionByName(rows))


def steps(graph, limits):
    start = start_vector(graph, limits)
    return start, start.lay_out(["dst"])


def test_a_large_step_shuffles_only_the_contributions(spark, graph):
    start, layout = steps(graph, Limits(broadcast_rows=10))
    with static_plans(spark):
        one = cut(naive_step(start.vector.select("id", "rank"), layout, True))
        plan = physical(naive_step(one, layout, False))
    assert len(exchanges(plan)) == 1, plan
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning")
    # Stored links are sorted already: the only sort is that of the vector.
    (scan,) = scans(plan)
    assert "Bucketed: true" in scan and plan.count("Sort [") == 1, plan


def test_a_large_block_step_shuffles_only_sums(spark, graph):
    start = start_vector(graph, Limits(broadcast_rows=10))
    derive = partial(_split_links, 100, "range", start.vector)
    layout = start.lay_out(["near", "far"], derive)
    with static_plans(spark):
        one = cut(block_step(start.vector.select("id", "rank"), layout, 1, True))
        passes = {
            ("near",): physical(local_ranks(one, layout, 1)),
            ("near", "far"): physical(block_step(one, layout, 1, False)),
        }
    for links, plan in passes.items():
        assert len(exchanges(plan)) == len(links), plan
        # Each pass reads only the links it needs.
        assert len(scans(plan)) == len(links)
        for read, scan in zip(links, sorted(scans(plan), key=lambda line: "near" in line, reverse=True), strict=True):
            assert read in scan and {"near": "far", "far": "near"}[read] not in scan


def test_blocks_are_brought_together(spark, graph):
    start = start_vector(graph, Limits(broadcast_rows=10))
    derive, block = partial(_split_links, 50, "range", start.vector), partial(block_of, block_size=50)
    layout = start.lay_out(["near", "far"], derive, block)
    assert layout.placement is not None
    with static_plans(spark):
        one = cut(block_step(start.vector.select("id", "rank"), layout, 1, True))
        near, step = physical(local_ranks(one, layout, 1)), physical(block_step(one, layout, 1, False))
    # Local sums never leave their block's partition; only external ones and the new vector move.
    assert len(exchanges(near)) == 0 and len(scans(near)) == 1, near
    assert len(exchanges(step)) == 2 and len(scans(step)) == 2, "\n".join(line[:150] for line in step.splitlines() if "Scan" in line or "Exchange" in line or "Join" in line)
    assert exchanges(step)[0].count("of#") == 1 and "partial_sum" in step
    # As many blocks as partitions are enough: each has its own.
    layout = start.lay_out(["near", "far"], derive, partial(block_of, block_size=500))
    assert layout.light.select("part").distinct().count() == start.partitions == 4
    # Too few blocks: by vertex.
    layout = start.lay_out(["near", "far"], derive, partial(block_of, block_size=2000))
    assert layout.placement is None


def test_blocks_are_dealt_by_weight(spark):
    groups = spark.range(101).select("id", (F.pow(F.col("id"), 2) + 1).cast("bigint").alias("weight"))
    placed = spread_evenly(groups, "id", "weight", 7)
    sums = [r["w"] for r in placed.join(groups, "id").groupBy("partition").agg(F.sum("weight").alias("w")).collect()]
    assert len(sums) == 7 and max(sums) - min(sums) <= 100**2 + 1
    keys = partition_keys(spark, 7)
    found = keys.join(keys.repartition(7, "part").select("part", F.spark_partition_id().alias("there")), "part")
    assert sorted((r["partition"], r["there"]) for r in found.collect()) == [(i, i) for i in range(7)]


def test_co_located_blocks_share_partitions_evenly(spark):
    rows = spark.range(0, 4096).select(F.col("id").alias("src"), F.array(F.col("id")).alias("dst"))
    blocked = assign_blocks(rows, 64, co_locate=True)
    where = blocked.select("block_id", F.spark_partition_id().alias("at")).distinct().collect()
    assert len(where) == 64 and [sum(r["at"] == p for r in where) for p in range(4)] == [16] * 4


def jobs(spark, run):
    """Spark jobs that ``run`` starts."""
    group = f"count-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_rows=10)])
def test_a_threshold_needs_no_job_and_no_join(spark, graph, limits):
    plain = jobs(spark, lambda: matvec_iterate(graph, 3, output="vector", limits=limits))
    tested = jobs(spark, lambda: matvec_iterate(graph, 3, threshold=0.0, output="vector", limits=limits))
    assert plain == tested, (plain, tested)
    start, layout = steps(graph, limits)
    step = physical(naive_step(start.vector.select("id", "rank"), layout, False))
    assert step.count("Join") == 1, step


def test_a_loop_over_buckets_neither_shuffles_nor_caches_links(spark, graph, tmp_path):
    table = "bucketed_graph"
    save_buckets(graph, table, str(tmp_path / "graph"), 6)
    rows, limits = load_buckets(spark, table), Limits(broadcast_rows=10)
    start = start_vector(rows, limits, 6)
    layout = start.lay_out(["dst"])
    with static_plans(spark, 6):
        one = cut(naive_step(start.vector.select("id", "rank"), layout, True))
        plan = physical(naive_step(one, layout, False))
    assert len(exchanges(plan)) == 1 and "id#" in exchanges(plan)[0], plan
    (scan,) = scans(plan)
    assert table in scan and "Bucketed: true" in scan and "InMemoryTableScan" not in plan
    got = matvec_iterate(rows, 3, output="vector", limits=limits, buckets=6)
    want = matvec_iterate(graph, 3, output="vector")
    assert max_rank_difference(got, want).first()[0] < 1e-12
    spark.sql(f"drop table {table}")


def read_rows(df):
    """Rows that the scans of a plan delivered."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def visit(node):
        metrics = node.metrics()
        if "Scan" in node.nodeName() and metrics.contains("numOutputRows"):
            found.append(metrics.apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan)
    return sum(found)


def test_a_range_reads_few_files(spark, graph, tmp_path):
    path = str(tmp_path / "clustered")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # the test's rows are few
    save_graph(graph, path, clustered=True)
    spark.conf.unset(coalesce)
    part = load_graph(spark, path, first=300, last=399)
    assert "PushedFilters: [IsNotNull(src), GreaterThanOrEqual(src,300), LessThanOrEqual(src,399)]" in physical(part)
    assert sorted(r["src"] for r in part.select("src").collect()) == list(range(300, 400))
    total = spark.read.parquet(path).count()
    assert total == 2000 and read_rows(part) <= total // 2


def test_pairs_of_a_stored_order_are_not_sorted(spark, graph, tmp_path):
    vector, path = rank_vector(graph).withColumn("rank", F.rand(3)), str(tmp_path / "sorted")
    vector = cut(vector)
    save_sorted(vector, path)
    pairs = pair_adjacent(load_positions(spark, path))
    assert "rangepartitioning" not in physical(pairs)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, pair_adjacent(vector).collect()))


def test_graphs_without_split_rows_are_written_without_a_shuffle(spark, graph):
    whole = merge_segments(graph.withColumn("segment", F.lit(0).cast("bigint")))
    assert exchanges(physical(whole)) == [] and "segment" not in whole.columns
    split = merge_segments(with_hub(spark, graph))
    assert split.where("src = 5000").first()["dst"] == list(range(2000)) and split.count() == 2001


def test_a_single_step_caches_nothing(spark, graph):
    start = start_vector(graph, Limits(broadcast_rows=10))
    plan = physical(_opening(start))
    assert len(exchanges(plan)) == 1 and "Join" not in plan and "InMemory" not in plan


def test_heavy_vertices_are_not_shuffled(spark, graph):
    start, layout = steps(with_hub(spark, graph), Limits(max_links=100, broadcast_rows=100))
    assert [r["id"] for r in start.heavy_ids.collect()] == [5000]
    assert layout.heavy.count() == 20 and layout.light.where("src = 5000").count() == 0
    with static_plans(spark):
        one = cut(naive_step(start.vector.select("id", "rank"), layout, True))
        plan = physical(naive_step(one, layout, False))
    assert len(exchanges(plan)) == 1, plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    assert len(scans(plan)) == 2, plan


@pytest.mark.parametrize("limits", [Limits(), Limits(max_links=100, broadcast_rows=500)])
@pytest.mark.parametrize("by", [None, "range", "position"])
def test_every_step_reads_the_stored_links(spark, graph, limits, by):
    rows = with_hub(spark, graph)
    start = start_vector(rows, limits)
    if by is None:
        layout = start.lay_out(["dst"])
        step = naive_step
    else:
        derive = partial(_split_links, 100, by, start.vector)
        layout = start.lay_out(["near", "far"], derive)
        step = partial(block_step, inner=1)
    vector = start.vector.select("id", "rank")
    assert (layout.heavy is not None) != start.small
    for first in (True, False):
        new = step(vector, layout, first=first)
        passes = 1 if by is None or not start.small else 2  # large: the local pass is cut off
        assert len(scans(physical(new))) == passes * (1 if start.small else 2)
        vector = cut(new)


def test_a_small_vector_is_broadcast(spark, graph):
    start, layout = steps(graph, Limits())
    plan = physical(naive_step(start.vector.select("id", "rank"), layout, True))
    assert len(exchanges(plan)) == 1 and "SortMergeJoin" not in plan, plan


def test_sorting_is_by_range(graph):
    plan = physical(sort_by_rank(graph))
    assert "rangepartitioning" in plan and "SinglePartition" not in plan
    assert "TakeOrderedAndProject" in physical(sort_by_rank(graph, limit=5))


def test_scans_read_only_the_columns_they_need(spark):
    lineitem = spark.read.parquet(os.path.join(SMALLEST, "lineitem.parquet"))
    plan = physical(transpose(edges_to_adjacency(supply_edges(lineitem))))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan


def test_checkpoint_folder_comes_from_the_session(spark):
    assert ensure_checkpoint_dir(spark).startswith("file:" + spark.conf.get("spark.checkpoint.dir"))
