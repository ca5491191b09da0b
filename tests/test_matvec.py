from fractions import Fraction as Fr

import pytest
from pyspark.sql import functions as F

from adjrank import (
    Limits,
    adjacency_to_edges,
    edges_to_adjacency,
    matvec,
    matvec_iterate,
    partitioned_matvec,
    partitioned_matvec_iterate,
    unconverged_count,
)

# Default; shuffled vector with a checked number of rows; heavy vertices (degree above 2).
WAYS = {
    "broadcast": Limits(),
    "shuffled": Limits(broadcast_rows=5),
    "heavy": Limits(max_links=2, broadcast_rows=5),
}

NAIVE = {
    1: [Fr(2, 3), Fr(1, 2), 2, Fr(1, 3), Fr(1, 2), 1, 0],
    2: [Fr(4, 3), Fr(1, 3), 1, Fr(2, 3), Fr(1, 6), Fr(1, 2), 0],
    3: [Fr(2, 3), Fr(2, 3), Fr(4, 3), Fr(1, 3), Fr(1, 3), Fr(1, 6), 0],
}
# (block size, inner, steps)
BLOCKED = {
    (2, 1, 1): [Fr(1, 3), 0, 1, 0, Fr(1, 6), 1, 0],
    (2, 1, 2): [0, 0, Fr(1, 3), 0, Fr(1, 6), 0, 0],
    (2, 2, 1): [Fr(2, 3), 0, Fr(3, 2), 0, Fr(1, 3), 1, 0],
    (2, 2, 2): [0, 0, 1, 0, Fr(1, 2), 0, 0],
    (2, 3, 1): [1, 0, 2, 0, Fr(1, 2), 1, 0],
    (2, 3, 2): [0, 0, 2, 0, 1, 0, 0],
    (1, 1, 1): NAIVE[1],
    (1000, 1, 1): [0, 0, 0, 0, 0, Fr(1, 2), 0],
}


def vector(df):
    return {r["id"]: r["rank"] for r in df.collect()}


def expect(values):
    return {i: pytest.approx(float(v), abs=1e-12) for i, v in enumerate(values)}


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("steps", [1, 3])
def test_naive_steps(g7, way, steps):
    out = matvec_iterate(g7, steps, output="vector", limits=WAYS[way])
    assert vector(out) == expect(NAIVE[steps])


@pytest.mark.parametrize("case", BLOCKED)
def test_block_steps(g7, case):
    size, inner, steps = case
    way = WAYS["heavy" if inner > 1 else "shuffled" if size == 2 else "broadcast"]
    out = partitioned_matvec_iterate(g7, size, steps, inner, output="vector", limits=way)
    assert vector(out) == expect(BLOCKED[case])


@pytest.mark.parametrize("way", WAYS)
def test_rows_keep_their_links(g7, way):
    out = {r["src"]: (r["dst"], r["rank"]) for r in matvec(g7, limits=WAYS[way]).collect()}
    assert {s: d for s, (d, _) in out.items()} == {
        0: [1, 2], 1: [2], 2: [0, 0, 3], 3: [2, 4], 4: [5], 5: [], 6: [],
    }
    assert {s: r for s, (_, r) in out.items()} == expect(NAIVE[1])


@pytest.mark.parametrize("way", WAYS)
def test_segmented_rows_count_as_one_vertex(g7, way):
    rows = edges_to_adjacency(adjacency_to_edges(g7), Limits(max_links=1, broadcast_rows=100))
    assert rows.where("src = 2").count() == 3
    rows = rows.withColumn("rank", F.lit(1.0))
    out = matvec_iterate(rows, 2, output="vector", limits=WAYS[way])
    want = expect(NAIVE[2])
    del want[6]
    assert vector(out) == want
    blocked = partitioned_matvec_iterate(rows, 2, 2, 2, output="vector", limits=WAYS[way])
    want = expect(BLOCKED[2, 2, 2])
    del want[6]
    assert vector(blocked) == want
    kept = matvec(rows, limits=WAYS[way])
    assert sorted(d for r in kept.where("src = 2").collect() for d in r["dst"]) == [0, 0, 3]


def by_hand(rows, size, inner, steps, by):
    """Block steps on a dict of rows, one block after the other."""
    rows = dict(rows)
    for _ in range(steps):
        ids = sorted(rows)
        block = {v: (v // size if by == "range" else ids.index(v) // size) for v in ids}
        local = {}
        for v, (links, rank) in rows.items():
            for d in links:
                if inner and block.get(d) == block[v]:
                    local[d] = local.get(d, 0) + inner * rank / len(links)
        new = {v: 0 for v in ids}
        for v, (links, rank) in rows.items():
            for d in links:
                if block.get(d) != block[v]:
                    new[d] = new.get(d, 0) + local.get(v, rank) / len(links)
        rows = {v: (rows[v][0] if v in rows else [], r) for v, r in new.items()}
    return {v: r for v, (_, r) in rows.items()}


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("by", ["range", "position"])
@pytest.mark.parametrize("size", [2, 3])
def test_block_steps_against_a_literal_loop(spark, way, by, size):
    rows = {3: [7, 8, 40], 7: [3, 3], 8: [9, 30], 20: [21, 3, 7], 21: [20, 22], 40: [3, 20, 21], 41: []}
    df = spark.createDataFrame([(s, d, 1.0) for s, d in rows.items()], "src bigint, dst array<bigint>, rank double")
    for inner, steps in [(0, 1), (2, 3)] if size == 2 else [(1, 2)]:
        want = by_hand({s: (d, Fr(1)) for s, d in rows.items()}, size, inner, steps, by)
        got = partitioned_matvec_iterate(df, size, steps, inner, by=by, output="vector", limits=WAYS[way])
        assert vector(got) == {v: pytest.approx(float(r), abs=1e-12) for v, r in want.items()}


def test_options(g7):
    one = vector(matvec_iterate(g7, output="vector"))
    assert one == expect(NAIVE[1])
    assert vector(matvec_iterate(g7, 0, output="vector")) == one
    with pytest.raises(ValueError):
        matvec_iterate(g7, -1)
    with pytest.raises(ValueError):
        partitioned_matvec(g7, 0)
    with pytest.raises(ValueError):
        partitioned_matvec(g7, 2, inner=-1)
    with pytest.raises(ValueError, match="output"):
        matvec_iterate(g7, 1, output="edges")


@pytest.mark.parametrize("way", WAYS)
def test_threshold(spark, g7, way):
    # Largest change: 1 in the steps 1 and 2, 2/3 in step 3.
    out = matvec_iterate(g7, threshold=0.7, output="vector", limits=WAYS[way])
    assert vector(out) == expect(NAIVE[3])
    assert vector(matvec_iterate(g7, 2, threshold=0.7, output="vector", limits=WAYS[way])) == expect(NAIVE[2])
    ring = spark.createDataFrame([(0, [1], 1.0), (1, [0], 2.0)], g7.schema)
    with pytest.raises(RuntimeError, match="after 4 steps"):
        matvec_iterate(ring, threshold=-1.0, max_iterations=4, limits=WAYS[way])
    still = spark.createDataFrame([(0, [1], 1.0), (1, [0], 1.0)], g7.schema)
    assert vector(matvec_iterate(still, threshold=0.0, output="vector")) == {0: 1.0, 1: 1.0}


def test_unconverged_count(g7):
    old = g7.select(F.col("src").alias("id"), "rank")
    new = matvec_iterate(g7, output="vector")
    assert unconverged_count(old, new, 0.5).first()[0] == 4
    assert unconverged_count(old, new).first()[0] == 7
    assert unconverged_count(new, new, 0.0).first()[0] == 0


def test_repeated_rows_are_refused(spark, g7):
    twice = g7.unionAll(g7.where("src < 2"))
    with pytest.raises(ValueError, match="^2 vertices"):
        matvec(twice)
    number = twice.withColumn("segment", F.monotonically_increasing_id())
    assert vector(matvec_iterate(number, output="vector"))[2] == pytest.approx(2.0)


def test_empty_graph(spark, g7):
    none = g7.where("src < 0")
    assert matvec(none).count() == 0
    assert partitioned_matvec(none, 4, limits=WAYS["heavy"]).count() == 0
    loose = spark.createDataFrame([(1, [], 3.0)], g7.schema)
    assert vector(matvec_iterate(loose, 2, output="vector")) == {1: 0.0}


def test_session_settings_are_restored(spark, g7):
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    matvec_iterate(g7, 2, limits=WAYS["heavy"])
    assert spark.conf.get(key) == before
