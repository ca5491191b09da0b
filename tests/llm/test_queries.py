"""The registered queries, against their SQL or the tables' own facts."""

import os

import pytest
from oracle_check import connect, mismatch

import __spark_entry__ as entry
import corpus_pipeline
from adjrank.llm import queries

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert mismatch(queries.queries()[name](spark, SMALLEST), connect(SMALLEST), queries.oracle_sql()[name]) is None


def test_one_query_for_each_operator():
    names = set(entry.queries()) - set(entry.graph_queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names - {"pipeline"}) == list(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_spotsigs", "op5_source_mix"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.queries()[name](spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(os.path.join(SMALLEST, "documents.parquet"))
    before = {r.doc_id: r for r in docs.collect()}
    counts = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALLEST).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == docs.columns and {r.doc_id for r in after.select("doc_id").collect()} <= set(before)
        docs = after
        counts.append(docs.count())
    assert counts[1] < 200 and counts[2] <= counts[1]
    pieces = docs.collect()
    used = {}
    for r in pieces:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096 and len(used) <= sum(used.values()) // 4096 + 2
    assert corpus_pipeline.run(spark, SMALLEST).count() == len(pieces)
    empty = spark.read.parquet(os.path.join(SMALLEST, "documents.parquet")).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALLEST).count() == 0
