"""Every registered query against its SQL, and what its plan must not contain."""

import os

import pytest

import __spark_entry__ as entry
from workload.compare import connect, same, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    cols, got = spark_rows(df)
    if name in ORACLE:
        want_cols, want = sql_rows(con, ORACLE[name])
        assert cols == want_cols
        assert same(got, want)
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scores_are_computed_where_the_chunk_lies(spark):
    """Between the tokens of a chunk and the best k of a partition nothing is shuffled."""
    from groundwell.operators import lexical
    from workload import bindings as b

    index = lexical.build_index(b.chunks(spark, SF))
    asked = b.requests(spark, SF).where("workspace_id IN ('ws1', 'ws2')")
    plan = lexical.score(index, asked, small_queries=True)._jdf.queryExecution().executedPlan().toString()
    assert [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "chunk_id" in x] == []
    assert "Bucketed: true" in plan
    # All four workspaces have a segment of their own, and the files of two are read.
    assert index.state["own"] == ["ws0", "ws1", "ws2", "ws3"]
    read = {os.path.basename(os.path.dirname(f)) for f in index.asked_by(asked).postings.inputFiles()}
    assert sorted(f.partition("-")[0] for f in read) == ["part=w2", "part=w3"]


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["token_sums"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :]
    assert "ts:" not in read and "value:" not in read
