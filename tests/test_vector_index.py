"""The kept vector index against the plain exact search."""

import numpy as np
import pytest

from groundwell.operators import vector_index, vectors


def _frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, grp string, vector array<double>")


def _clustered(seed, groups=("a", "b"), clusters=12, each=40, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    vecs = np.concatenate([c + 0.05 * rng.normal(size=(each, size)) for c in centres])
    return [(i, groups[i % len(groups)], [float(x) for x in v]) for i, v in enumerate(vecs)]


def _top(df):
    return [(r[0], r[1], pytest.approx(r[2], abs=1e-8), r[3]) for r in df.orderBy("query_id", "vector_rank").collect()]


@pytest.mark.parametrize("block", [4_000, 3])
def test_index_equals_plain_search_and_skips_cells(spark, tmp_path, monkeypatch, block):
    items = _clustered(1)
    asked = [(i, "ab"[i % 2], items[i * 31][2]) for i in range(10)]
    v, q = _frame(spark, items, "item_id"), _frame(spark, asked, "query_id")
    index = vector_index.build(v, str(tmp_path / "index"), cells=12)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    assert index.top_k(q, 5).orderBy("query_id", "vector_rank").collect() == _top(vectors.top_k(q, v, 5))
    visits = index.search(q, 5)[1].collect()
    # Twenty vectors a group and cluster: a request for five needs one cell, of twelve, or little more.
    assert sum(r["n"] for r in visits) < 0.25 * sum(len([i for i in items if i[1] == a[1]]) for a in asked)


def test_index_with_ties_zero_vectors_and_small_groups(spark, tmp_path):
    rng = np.random.default_rng(3)
    items = [(i, "aaab"[i % 4], [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(80)]
    items += [(100, "a", [0.0, 0.0, 0.0]), (101, "c", [1.0, 0.0, 0.0]), (102, "a", None), (103, None, [1.0, 0.0, 0.0])]
    asked = [(i, "abcd"[i % 4], [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(30)]
    asked += [(50, "a", [0.0, 0.0, 0.0]), (51, "a", None)]
    v, q = _frame(spark, items, "item_id"), _frame(spark, asked, "query_id")
    index = vector_index.build(v, str(tmp_path / "index"), cells=7)
    assert index.top_k(q, 4).orderBy("query_id", "vector_rank").collect() == _top(vectors.top_k(q, v, 4))


def test_unvisited_cells_are_not_read(spark, tmp_path):
    items = _clustered(5)
    index = vector_index.build(_frame(spark, items, "item_id"), str(tmp_path / "index"), cells=12)
    plan = index.rows([2, 3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    norms = [np.linalg.norm(r["unit"]) for r in index.rows().collect()]
    assert np.allclose(norms, 1.0) and len(norms) == len(items)


def test_empty_index(spark, tmp_path):
    index = vector_index.build(_frame(spark, [], "item_id"), str(tmp_path / "index"))
    assert index.top_k(_frame(spark, [(1, "a", [1.0])], "query_id"), 3).collect() == []
