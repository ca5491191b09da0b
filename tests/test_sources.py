import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from adjrank import (
    generate_blocked_graph,
    load_graph,
    read_adjacency,
    read_rank_vector,
    read_ranked_adjacency,
    save_graph,
    write_adjacency,
    write_edges,
    write_pairs,
    write_rank_vector,
    write_ranked_adjacency,
)
from adjrank.functions import block_of
from adjrank.sources import text

GOOD = {
    "1 3 5 6 7 0.5": (1, [5, 6, 7], 0.5),
    "2 0 1.0": (2, [], 1.0),
    "3 3 5 6 0.5": (3, [5, 6], 0.5),
    "4 3 5 0.5": (4, [5], 0.5),
    "5 1 5 6 0.5": (5, [5], 0.5),
    "7 2 5 y 0.25": (7, [5], 0.25),
    "8 1 9 1.0E-4": (8, [9], 1.0e-4),
    "12 2 y 5 0.25": (12, [], 0.25),
    "-3 1 +4 2": (-3, [4], 2.0),
    "13 1 5 0.5   ": (13, [5], 0.5),
    "9000000000 1 9000000001 1.5": (9000000000, [9000000001], 1.5),
    # The rank stands where the missing link would, and is a bare integer.
    "14 2 5 3": (14, [5, 3], 3.0),
}
BAD = ["x 1 2 1.0", "", "9", "6 1 5 oops", "10 -1 0.5", "11 1", "1.0 0 1.0", "   ", " 1 0 1.0", "1\t0 0 1.0"]


@pytest.fixture
def lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([(line,) for line in [*GOOD, *BAD]], "value string").write.text(path)
    return path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ranked_lines(spark, lines):
    assert rows(read_ranked_adjacency(spark, lines)) == sorted(GOOD.values(), key=str)
    assert dict(read_ranked_adjacency(spark, lines).dtypes) == {
        "src": "bigint", "dst": "array<bigint>", "rank": "double",
    }


def test_permissive_keeps_bad_lines(spark, lines):
    df = read_ranked_adjacency(spark, lines, mode="permissive")
    bad = df.where("_corrupt_record is not null")
    assert sorted(r["_corrupt_record"] for r in bad.collect()) == sorted(BAD)
    assert bad.where("src is not null or dst is not null or rank is not null").count() == 0
    assert df.where("_corrupt_record is null").count() == len(GOOD)


def test_failfast(spark, lines, tmp_path):
    with pytest.raises(PySparkException, match="malformed adjacency line"):
        read_ranked_adjacency(spark, lines, mode="FAILFAST").count()
    path = str(tmp_path / "good")
    spark.createDataFrame([(line,) for line in GOOD], "value string").write.text(path)
    assert read_ranked_adjacency(spark, path, mode="FAILFAST").count() == len(GOOD)
    with pytest.raises(ValueError):
        read_ranked_adjacency(spark, lines, mode="IGNORE")


def test_unranked_lines(spark, tmp_path):
    text = {"1 2 5 6": (1, [5, 6]), "2 0": (2, []), "3 3 5 6": (3, [5]), "4 1 5 9": (4, [5])}
    path = str(tmp_path / "plain")
    spark.createDataFrame([(line,) for line in [*text, "x 0", "5"]], "value string").write.text(path)
    assert rows(read_adjacency(spark, path)) == sorted(text.values())
    keyed = str(tmp_path / "keyed")
    spark.createDataFrame([(f"77\t{line}",) for line in text], "value string").write.text(keyed)
    assert rows(read_adjacency(spark, keyed, keyed=True)) == sorted(text.values())
    assert read_adjacency(spark, keyed).count() == 0


def test_rank_vector_lines(spark, tmp_path):
    path = str(tmp_path / "vector")
    text = ["1\t0.5", "  2   1.0E-3  tail", "x\t1.0", "3", "4\tone", "", "5 7"]
    spark.createDataFrame([(line,) for line in text], "value string").write.text(path)
    assert rows(read_rank_vector(spark, path)) == [(1, 0.5), (2, 0.001), (5, 7.0)]


def test_text_round_trips(spark, g7, tmp_path):
    path = str(tmp_path / "g7")
    write_ranked_adjacency(g7, path)
    assert sorted(r[0] for r in spark.read.text(path).collect()) == [
        "0 2 1 2 1.0", "1 1 2 1.0", "2 3 0 0 3 1.0", "3 2 2 4 1.0", "4 1 5 1.0", "6 0 1.0",
    ]
    assert rows(read_ranked_adjacency(spark, path)) == rows(g7)
    plain = str(tmp_path / "plain")
    write_adjacency(g7, plain)
    assert rows(read_adjacency(spark, plain)) == rows(g7.select("src", "dst"))


def test_lines_of_split_vertices_are_streamed(spark, tmp_path):
    lists = {1: [5, 6, 7, 8, 9], 2: [1], 3: [], 4: list(range(100, 140)), 6: [7, 7, 8], **{i: [i, i + 1, i + 2] for i in range(20, 60)}}
    rows_ = [
        (src, segment, dst[2 * segment : 2 * segment + 2], src / 4)
        for src, dst in lists.items()
        for segment in range(max(1, -(-len(dst) // 2)))
    ]
    rows_ += [(70, 0, [], 1.0), (70, 1, [3], 1.0), (70, 2, [], 1.0), (71, 3, [], 2.0), (71, 5, [], 2.0)]
    lists |= {70: [3], 71: []}
    graph = spark.createDataFrame(rows_, "src bigint, segment bigint, dst array<bigint>, rank double").repartition(7)
    pieces = text._line_pieces(graph.where("src != 2"))
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    path, plain = str(tmp_path / "lines"), str(tmp_path / "plain")
    write_ranked_adjacency(graph, path)
    rank = {src: value for src, _, _, value in rows_}
    expected = sorted(" ".join(map(str, [src, len(dst), *dst, rank[src]])) for src, dst in lists.items())
    assert sorted(r[0].rstrip(" ") for r in spark.read.text(path).collect()) == expected
    assert rows(read_ranked_adjacency(spark, path)) == sorted(((src, dst, rank[src]) for src, dst in lists.items()), key=str)
    write_adjacency(graph, plain)
    assert rows(read_adjacency(spark, plain)) == sorted(((src, dst) for src, dst in lists.items()), key=str)
    with pytest.raises(PySparkException):
        write_ranked_adjacency(graph, path)
    write_ranked_adjacency(graph, path, mode="overwrite")
    assert read_ranked_adjacency(spark, path).count() == len(lists)


def test_tabbed_sinks(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (3, 4)], "src bigint, dst bigint")
    write_edges(edges, str(tmp_path / "e"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "e")).collect()) == ["1\t2", "3\t4"]
    write_pairs(edges.toDF("a", "b"), str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).count() == 2
    vector = spark.createDataFrame([(1, 0.25), (2, 1.0e-7)], "id bigint, rank double")
    write_rank_vector(vector, str(tmp_path / "v"))
    assert rows(read_rank_vector(spark, str(tmp_path / "v"))) == [(1, 0.25), (2, 1.0e-7)]


def test_typed_table(spark, g7, tmp_path):
    path = str(tmp_path / "table")
    save_graph(g7.withColumn("src", F.col("src").cast("int")), path)
    back = load_graph(spark, path)
    assert back.dtypes == [("src", "bigint"), ("dst", "array<bigint>"), ("rank", "double")]
    assert rows(back) == rows(g7)
    assert load_graph(spark, path, ranked=False).columns == ["src", "dst"]
    with pytest.raises(ValueError, match="dst"):
        save_graph(g7.drop("dst"), str(tmp_path / "none"))


def check_generated(df, n, degree, ratio, size, members=None):
    size = max(size, 2 * degree)
    got = {r["src"]: (r["dst"], r["rank"]) for r in df.collect()}
    assert sorted(got) == list(range(n))
    for src, (dst, rank) in got.items():
        start = src // size * size
        end = min(start + size, n)
        near = [d for d in dst if start <= d < end]
        far = [d for d in dst if not start <= d < end]
        assert rank == 1.0 and dst == sorted(set(dst)) and src not in dst
        assert all(0 <= d < n for d in dst) and len(dst) < 2 * degree
        if end - start > 2 * degree and n - (end - start) > 2 * degree:
            assert len(far) == int(ratio * len(dst) + 1e-6)
        else:
            assert len(near) <= end - start - 1 and len(far) <= n - (end - start)
    return got


def test_generator_invariants(spark):
    got = check_generated(generate_blocked_graph(spark, 1000, 5, 0.3, 100, seed=3), 1000, 5, 0.3, 100)
    degrees = [len(dst) for dst, _ in got.values()]
    assert min(degrees) == 0 and max(degrees) == 9
    assert 4.2 < sum(degrees) / len(degrees) < 4.8
    spread = [0] * 10
    for src, (dst, _) in got.items():
        for d in dst:
            spread[d % 10] += 1
    assert max(spread) < 1.3 * min(spread)


@pytest.mark.parametrize("n, degree, ratio, size", [(50, 4, 0.5, 100), (103, 6, 0.9, 12), (7, 1, 1.0, 1), (30, 8, 0.0, 10)])
def test_generator_runs_out_of_vertices(spark, n, degree, ratio, size):
    check_generated(generate_blocked_graph(spark, n, degree, ratio, size), n, degree, ratio, size)


def test_generator_is_seeded(spark):
    one = generate_blocked_graph(spark, 400, 4, 0.25, 64, seed=1)
    again = generate_blocked_graph(spark, 400, 4, 0.25, 64, seed=1).repartition(3)
    other = generate_blocked_graph(spark, 400, 4, 0.25, 64, seed=2)
    assert rows(one) == rows(again)
    assert rows(one) != rows(other)
    assert generate_blocked_graph(spark, 0, 4, 0.25, 64).count() == 0
    for wrong in ({"degree": 0}, {"border_ratio": 1.5}, {"block_size": 0}, {"n": -1}):
        with pytest.raises(ValueError):
            generate_blocked_graph(spark, **{"n": 5, "degree": 1, "border_ratio": 0.1, "block_size": 4, **wrong})


def test_generator_widens_its_draws(spark):
    n, size = 1 << 25, 1 << 24
    few = generate_blocked_graph(spark, n, 2, 0.5, size, seed=5).limit(200).collect()
    links = [(r["src"], d) for r in few for d in r["dst"]]
    assert all(0 <= d < n and d != s for s, d in links)
    assert any(d >= size for _, d in links) and any(d < size for _, d in links)


def test_block_of_is_exact(spark):
    big = (1 << 61) + 7
    df = spark.createDataFrame([(big,), (-1,), (9,)], "id bigint")
    assert [r[0] for r in df.select(block_of(F.col("id"), 10)).collect()] == [big // 10, -1, 0]
