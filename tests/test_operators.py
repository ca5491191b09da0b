import pytest
from pyspark.sql import functions as F

from adjrank import (
    Limits,
    adjacency_to_edges,
    assign_blocks,
    attach_rank,
    classify_edges,
    edges_to_adjacency,
    generate_blocked_graph,
    global_index,
    matvec_iterate,
    max_rank_difference,
    naive_nsd,
    out_degree,
    pair_adjacent,
    partitioned_matvec_iterate,
    partitioned_nsd,
    range_of,
    rank_deltas,
    rank_vector,
    ranked_from_decoded,
    self_match,
    sort_by_rank,
    transpose,
    vertex_ranges,
)
from adjrank.plans.order_graphs import basket_edges

TIGHT = Limits(max_links=3, broadcast_rows=40)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_conversions_on_the_hand_graph(g7):
    edges = [(0, 1), (0, 2), (1, 2), (2, 0), (2, 0), (2, 3), (3, 2), (3, 4), (4, 5)]
    assert rows(adjacency_to_edges(g7)) == edges
    assert rows(transpose(g7)) == [
        (0, 0, [2, 2]), (1, 0, [0]), (2, 0, [0, 1, 3]), (3, 0, [2]), (4, 0, [3]), (5, 0, [4]),
    ]
    assert rows(out_degree(g7)) == [(0, 2), (1, 1), (2, 3), (3, 2), (4, 1), (6, 0)]
    assert rows(attach_rank(g7.drop("rank"), 0.5).select("src", "rank"))[0] == (0, 0.5)
    assert rows(rank_vector(g7)) == [(i, 1.0) for i in (0, 1, 2, 3, 4, 6)]


def star(spark, links=2000, copies=500):
    """A third of all edges leaves vertex 0, another third enters it; one edge has many copies."""
    hub = spark.range(links).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    back = hub.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ring = spark.range(links).select(F.col("id").alias("src"), ((F.col("id") + 1) % links).alias("dst"))
    same = spark.range(copies).select(F.lit(0).cast("bigint").alias("src"), F.lit(7).cast("bigint").alias("dst"))
    return hub.unionAll(back).unionAll(ring).unionAll(same)


# Heavy by a range sort; sliced after gathering, as too many vertices are large.
@pytest.mark.parametrize("limits", [Limits(max_links=100, broadcast_rows=1000), Limits(max_links=100, broadcast_rows=2)])
def test_segments_of_a_hub(spark, limits):
    edges = star(spark)
    got = edges_to_adjacency(edges, limits)
    assert got.agg(F.max(F.size("dst"))).first()[0] == 100
    assert rows(adjacency_to_edges(got)) == rows(edges)
    hub = got.where("src = 0").orderBy("segment").collect()
    assert [r["segment"] for r in hub] == list(range(26))
    joined = [d for r in hub for d in r["dst"]]
    assert joined == sorted(joined) and len(joined) == 2502
    turned = transpose(got, limits)
    assert rows(adjacency_to_edges(turned)) == sorted((d, s) for s, d in rows(edges))


def test_star_ranks_do_not_depend_on_the_way(spark):
    limits = Limits(max_links=100, broadcast_rows=1000)
    graph = attach_rank(edges_to_adjacency(star(spark), limits)).checkpoint()
    plain = attach_rank(edges_to_adjacency(star(spark))).checkpoint()
    for run in (
        lambda g, lim: matvec_iterate(g, 3, output="vector", limits=lim),
        lambda g, lim: partitioned_matvec_iterate(g, 64, 3, 2, output="vector", limits=lim),
        lambda g, lim: partitioned_matvec_iterate(g, 64, 2, 1, by="position", output="vector", limits=lim),
    ):
        assert max_rank_difference(run(graph, limits), run(plain, Limits())).first()[0] < 1e-9


def test_ranges(spark):
    assert rows(vertex_ranges(spark, 10, 3)) == [(0, 0, 3), (1, 4, 6), (2, 7, 9)]
    assert rows(vertex_ranges(spark, 2, 4)) == [(0, 0, 0), (1, 1, 1), (2, 2, 1), (3, 2, 1)]
    for n, s in [(10, 3), (2, 4), (9, 9), (100, 7), (0, 2)]:
        got = rows(spark.range(-2, n + 2).select("id", range_of(F.col("id"), n, s)))
        want = {i: r["split"] for r in vertex_ranges(spark, n, s).collect() for i in range(r["first"], r["last"] + 1)}
        assert got == [(i, want.get(i, -1)) for i in range(-2, n + 2)]
    with pytest.raises(ValueError):
        vertex_ranges(spark, 3, 0)


def test_decoded_graph(spark):
    edges = spark.createDataFrame([(1, 2), (1, 0), (1, 2), (4, 1)], "src bigint, dst bigint")
    assert rows(ranked_from_decoded(edges, 6, 4)) == [
        (0, 0, [], 1.0, 0), (1, 0, [0, 2, 2], 1.0, 0), (2, 0, [], 1.0, 1),
        (3, 0, [], 1.0, 1), (4, 0, [1], 1.0, 2), (5, 0, [], 1.0, 3),
    ]


@pytest.mark.parametrize("limits", [Limits(), TIGHT, Limits(max_links=2, broadcast_rows=3)])
def test_decoded_graph_in_two_reads(spark, limits):
    """Long lists, vertices without links and edges outside, all found by one counting pass."""
    links = [(3, i % 17) for i in range(60)] + [(9, 1), (9, 0), (11, 4)]
    edges = spark.createDataFrame(links, "src bigint, dst bigint")
    found = {}
    for src, segment, dst, rank, split in rows(ranked_from_decoded(edges, 20, 4, limits)):
        assert rank == 1.0 and split == src // 5 and segment == len(found.get(src, [])) // limits.max_links
        found[src] = found.get(src, []) + dst
    assert found == {src: sorted(d for s, d in links if s == src) for src in range(20)}
    with pytest.raises(ValueError, match="2 edges"):
        ranked_from_decoded(edges.unionByName(edges.where("src = 11")), 11, 4, limits)
    assert rows(ranked_from_decoded(edges.limit(0), 2, 1, limits)) == [(0, 0, [], 1.0, 0), (1, 0, [], 1.0, 0)]
    assert rows(ranked_from_decoded(edges.limit(0), 0, 1, limits)) == []


def test_blocks(spark, g7):
    assert rows(assign_blocks(g7, 2).select("src", "block_id")) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (6, 3)]
    by_position = assign_blocks(g7, 2, by="position", co_locate=True)
    assert rows(by_position.select("src", "block_id")) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (6, 2)]
    segmented = edges_to_adjacency(adjacency_to_edges(g7), Limits(max_links=1, broadcast_rows=100))
    blocks = assign_blocks(segmented, 2, by="position")
    assert rows(blocks.select("src", "block_id").distinct()) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]
    with pytest.raises(ValueError):
        assign_blocks(g7, 2, by="size")


@pytest.mark.parametrize("limits", [Limits(), Limits(max_links=1, broadcast_rows=100)])
def test_local_edges(g7, limits):
    edges = adjacency_to_edges(g7)
    got = classify_edges(edges, assign_blocks(g7, 2), limits)
    assert rows(got.where("is_local").drop("is_local")) == [(0, 1), (2, 3), (3, 2)]
    assert rows(got.drop("is_local")) == rows(edges)
    # 4 and 5 share the id range, but 5 has no row.
    assert not got.where("src = 4").first()["is_local"]


def test_differences(g7):
    start, new = rank_vector(g7), matvec_iterate(g7, output="vector")
    deltas = dict(rows(rank_deltas(start, new)))
    want = [1 / 3, 1 / 2, 1, 2 / 3, 1 / 2, 1, 1]
    assert deltas == {i: pytest.approx(d) for i, d in enumerate(want)}
    assert max_rank_difference(start, new).first()[0] == pytest.approx(1)
    assert max_rank_difference(new, new).first()[0] == 0.0


def test_order_and_pairs(g7):
    new = matvec_iterate(g7, output="vector").withColumn("rank", F.round("rank", 9))
    assert [r["id"] for r in sort_by_rank(new).collect()] == [2, 5, 0, 1, 4, 3, 6]
    assert [r["id"] for r in sort_by_rank(new, limit=3).collect()] == [2, 5, 0]
    assert [r["id"] for r in sort_by_rank(g7).collect()] == [0, 1, 2, 3, 4, 6]
    assert rows(pair_adjacent(new)) == [(0, 2, 5), (1, 0, 1), (2, 4, 3), (3, 6, 6)]
    assert rows(self_match(g7, 1, digits=9)) == rows(pair_adjacent(new))
    assert rows(naive_nsd(g7, 1, match=True, digits=9)) == rows(pair_adjacent(new))


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_positions_are_dense(spark, n):
    df = spark.range(n).select("id", (F.col("id") % 7).cast("double").alias("rank")).repartition(5)
    got = [tuple(r) for r in global_index(df).orderBy("pos").collect()]
    assert [r[2] for r in got] == list(range(n))
    assert [r[:2] for r in got] == sorted((r[:2] for r in got), key=lambda r: (-r[1], r[0]))


def test_equal_rows_get_their_own_positions(spark):
    df = spark.range(900).select(F.lit(1).alias("x"), (F.col("id") % 2).alias("y"))
    got = global_index(df, [F.asc("x"), F.asc("y")], unique=False)
    assert sorted(r["pos"] for r in got.collect()) == list(range(900))
    assert got.agg(F.max(F.when(F.col("y") == 0, F.col("pos")))).first()[0] == 449


def test_heavy_orders_take_the_other_way(spark):
    lines = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(1)).otherwise(F.col("id") % 400).alias("l_orderkey"),
        ((F.col("id") * 7) % 13).alias("l_partkey"),
        (F.col("id") % 5).alias("l_suppkey"),
        (F.col("id") % 3).alias("l_linenumber"),
        F.lit("x").alias("l_shipdate"),
        F.col("id").alias("l_extendedprice"),
    )
    want = rows(basket_edges(lines))
    assert rows(basket_edges(lines, Limits(max_links=50, broadcast_rows=100))) == want


def test_properties_of_a_random_graph(spark):
    graph = generate_blocked_graph(spark, 600, 4, 0.4, 50, seed=9).where("size(dst) > 0").checkpoint()
    edges = adjacency_to_edges(graph)
    turned = transpose(graph).checkpoint()
    assert turned.agg(F.sum(F.size("dst"))).first()[0] == edges.count()
    assert rows(transpose(turned).drop("segment")) == rows(graph.select("src", "dst"))
    # No links out of the graph: the sum of the ranks is kept.
    closed = attach_rank(edges_to_adjacency(edges.unionAll(edges.select("dst", "src")))).checkpoint()
    total = matvec_iterate(closed, 3, output="vector").agg(F.sum("rank")).first()[0]
    assert total == pytest.approx(closed.count())
    # Blocks of one vertex without self-links leave every link external.
    one = partitioned_matvec_iterate(graph, 1, 2, output="vector")
    assert max_rank_difference(one, matvec_iterate(graph, 2, output="vector")).first()[0] < 1e-12
    pairs = self_match(closed, 2).collect()
    ids = [r["a"] for r in pairs] + [r["b"] for r in pairs if r["b"] != r["a"]]
    assert sorted(ids) == sorted(r["src"] for r in closed.collect())


def test_shuffle_partitions_do_not_matter(spark):
    graph = generate_blocked_graph(spark, 300, 4, 0.4, 50, seed=9).checkpoint()
    key, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    want = rows(partitioned_nsd(graph, 32, 2, digits=9))
    try:
        for partitions in ("1", "13"):
            spark.conf.set(key, partitions)
            assert rows(partitioned_nsd(graph, 32, 2, digits=9, limits=TIGHT)) == want
    finally:
        spark.conf.set(key, before)
