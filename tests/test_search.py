import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.operators import access, fusion, lexical, vectors
from groundwell.session import scratch_dir

WORDS = [f"w{i}" for i in range(12)]
CHUNKS = "chunk_id long, workspace_id string, content string, task_id string, sensitivity_level string"
REQUESTS = "query_id long, workspace_id string, query string, vector array<double>, accessible_task_ids array<string>, can_view_restricted boolean"


def corpus(seed, n=60):
    rng = random.Random(seed)
    return [
        (
            i, "a" if rng.random() < 0.7 else "b", " ".join(rng.choices(WORDS, k=rng.randint(0, 12))),
            rng.choice([None, "t1", "t2", "t3"]), rng.choice(["normal", "normal", "restricted"]),
        )
        for i in range(n)
    ]


def bm25(chunks, workspace, query):
    """Okapi scores of one workspace, by the book."""
    docs = {c[0]: re.findall("[a-z0-9_]+", c[2].lower()) for c in chunks if c[1] == workspace}
    docs = {k: v for k, v in docs.items() if v}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    dfs = {w: sum(w in d for d in docs.values()) for w in {w for d in docs.values() for w in d}}
    idf = {w: math.log(n - df + 0.5) - math.log(df + 0.5) for w, df in dfs.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    scores = {}
    for cid, d in docs.items():
        scores[cid] = sum(
            idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query.split()
        )
    ranked = sorted(scores, key=lambda c: (-round(scores[c], 9), c))
    return [(c, scores[c]) for c in ranked if round(scores[c], 9) > 0]


@pytest.mark.parametrize("small", [True, False])
def test_bm25_equals_brute_force(spark, small, monkeypatch):
    # A tiny limit puts every term of the shuffle path on several tasks.
    monkeypatch.setattr(lexical, "PAIRS_PER_TASK", 3)
    chunks = corpus(1)
    asked = [(1, "a", "w1 w2 w2 nothing"), (2, "b", "w3"), (3, "a", ""), (4, "zz", "w1")]
    index = lexical.build_index(spark.createDataFrame(chunks, CHUNKS))
    q = spark.createDataFrame(asked, "query_id long, workspace_id string, query string")
    got = {}
    for r in lexical.top_k(index, q, 7, small_queries=small).orderBy("query_id", "bm25_rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], pytest.approx(r["score"], abs=1e-8)))
    assert set(got) <= {1, 2}
    for qid, ws, text in asked[:2]:
        assert got.get(qid, []) == bm25(chunks, ws, text)[:7]


def test_saved_index_with_context(spark):
    rows = [(1, "a", "alpha", "beta"), (2, "a", "beta", None), (3, "a", "gamma", ""), (4, "a", "delta", None), (5, "a", "eps", None)]
    df = spark.createDataFrame(rows, "chunk_id long, workspace_id string, content string, context string")
    path = scratch_dir(spark, "t")
    lexical.build_index(df, context="context", path=path)
    q = spark.createDataFrame([(1, "a", "beta")], "query_id long, workspace_id string, query string")
    got = lexical.top_k(lexical.LexicalIndex.load(spark, path), q, 5).orderBy("bm25_rank").collect()
    assert [r["chunk_id"] for r in got] == [2, 1]
    plain = lexical.top_k(lexical.build_index(df), q, 5).collect()
    assert [r["chunk_id"] for r in plain] == [2]


def test_another_tokenizer(spark):
    df = spark.createDataFrame([(1, "a", "x-y"), (2, "a", "z"), (3, "a", "u")], "chunk_id long, workspace_id string, content string")
    split = lambda c: F.split(c, "-")
    q = spark.createDataFrame([(1, "a", "y-q")], "query_id long, workspace_id string, query string")
    got = lexical.top_k(lexical.build_index(df, split), q, 3, split).collect()
    assert [r["chunk_id"] for r in got] == [1]


def cosine_top(items, vector, k, at=None, max_age=None):
    best = []
    for iid, v, t in items:
        if max_age is not None and at - t > max_age:
            continue
        n = np.linalg.norm(v) * np.linalg.norm(vector)
        best.append((-round(float(np.dot(v, vector)) / n, 9) + 0.0 if n else 0.0, iid))
    return [(iid, -s) for s, iid in sorted(best)[:k]]


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("max_age", [None, 20.0])
def test_vector_top_k_equals_brute_force(spark, small, max_age, monkeypatch):
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "QUERY_STEP", 2)
    rng = random.Random(3)
    # Small integers give many ties; one zero vector on each side.
    items = [(i, rng.choice("aab"), [float(rng.randint(-1, 1)) for _ in range(3)], float(i)) for i in range(50)]
    items[5] = (5, "a", [0.0, 0.0, 0.0], 5.0)
    asked = [(i, rng.choice("abc"), [float(rng.randint(-2, 2)) for _ in range(3)], 60.0) for i in range(11)]
    asked[0] = (0, "a", [0.0, 0.0, 0.0], 60.0)
    q = spark.createDataFrame(asked, "query_id long, grp string, vector array<double>, at double")
    v = spark.createDataFrame(items, "item_id long, grp string, vector array<double>, at double")
    got = {}
    for r in vectors.top_k(q, v, 4, max_age=max_age, small_queries=small).orderBy("query_id", "vector_rank").collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], pytest.approx(r["similarity"], abs=1e-8)))
    for qid, grp, vec, at in asked:
        mine = [(i, x, t) for i, g, x, t in items if g == grp]
        assert got.get(qid, []) == cosine_top(mine, vec, 4, at, max_age)


def test_fusion_adds_reciprocal_ranks_and_breaks_ties(spark):
    vec = spark.createDataFrame([(1, 10, 0.9, 0), (1, 11, 0.8, 1), (1, 12, 0.7, 2)], "query_id long, chunk_id long, similarity double, vector_rank int")
    lex = spark.createDataFrame([(1, 20, 0), (1, 10, 1), (2, 30, 4)], "query_id long, chunk_id long, bm25_rank int")
    got = [tuple(r) for r in fusion.rrf(vec, lex, 4).orderBy("query_id", "rank").collect()]
    assert [(g[0], g[2]) for g in got] == [(1, 10), (1, 20), (1, 11), (1, 12), (2, 30)]
    assert got[0][3] == pytest.approx(1 / 61 + 1 / 62) and got[0][4] == 0.9
    assert got[1][4] == 0.0


def allowed(chunk, tasks, can_view):
    return (tasks is None or chunk[3] is None or chunk[3] in tasks) and (can_view or chunk[4] != "restricted")


def one_request(chunks, vecs, request, k):
    """Two branches, one widening, fusion: request by request."""
    _, ws, text, vector, tasks, can_view = request
    by_id = {c[0]: c for c in chunks}
    free = tasks is None and can_view
    full_v = cosine_top([(c, v, 0) for c, v in vecs.items() if by_id[c][1] == ws], vector, 10**6)
    full_b = [c for c, _ in bm25(chunks, ws, text)]
    depth, refetched = 3 * k, False
    while True:
        page_v, page_b = full_v[:depth], full_b[:depth]
        v = [x for x in page_v if free or allowed(by_id[x[0]], tasks, can_view)]
        b = [(c, r) for r, c in enumerate(page_b) if free or allowed(by_id[c], tasks, can_view)]
        score = {}
        for r, (c, s) in enumerate(v):
            score[c] = [1 / (61 + r), r, 10**9, s]
        for c, r in b:
            e = score.setdefault(c, [0.0, 10**9, 10**9, 0.0])
            e[0] += 1 / (61 + r)
            e[2] = r
        top = sorted(score, key=lambda c: (-round(score[c][0], 12), score[c][1], score[c][2]))[:k]
        if free or refetched or len(top) >= k or not (len(page_v) >= depth or len(page_b) >= depth):
            return top, refetched
        depth, refetched = 6 * k, True


@pytest.mark.parametrize("small", [True, False])
def test_hybrid_equals_request_by_request(spark, small):
    chunks = corpus(5, 120)
    rng = random.Random(6)
    vecs = {c[0]: [rng.gauss(0, 1) for _ in range(4)] for c in chunks if rng.random() < 0.9}
    rights = [(None, True), (None, False), ([], False), ([], True), (["t1"], False), (["t2", "t3"], True)]
    asked = [
        (i, rng.choice("ab"), " ".join(rng.choices(WORDS, k=2)), [rng.gauss(0, 1) for _ in range(4)], *rights[i % 6]) for i in range(18)
    ]
    cdf = spark.createDataFrame(chunks, CHUNKS)
    vdf = spark.createDataFrame(list(vecs.items()), "chunk_id long, vector array<double>").join(cdf.select("chunk_id", "workspace_id"), "chunk_id")
    rdf = spark.createDataFrame(asked, REQUESTS)
    got, again = {}, {}
    for r in fusion.hybrid(rdf, cdf, lexical.build_index(cdf), vdf, 3, small_queries=small).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
        again[r["query_id"]] = r["refetched"]
    wants = {a[0]: one_request(chunks, vecs, a, 3) for a in asked}
    assert got == {q: top for q, (top, _) in wants.items() if top}
    assert any(again.values()) and again == {q: flag for q, (top, flag) in wants.items() if top}


def test_access_rule_tells_null_from_empty(spark):
    rows = [(None, False), ([], False), (["t1"], False), (["t1"], True), (None, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, tasks array<string>, v boolean")
    marks = [("x", None, "normal"), ("y", "t1", "normal"), ("z", "t2", "restricted")]
    for i, (tasks, view) in enumerate(rows):
        for _, task, sens in marks:
            rule = access.allowed(F.col("tasks"), F.col("v"), F.lit(task).cast("string"), F.lit(sens))
            assert df.where(f"i = {i}").select(rule.alias("r")).first()["r"] is allowed((0, 0, 0, task, sens), tasks, view)
    free = df.select("i", access.unrestricted(F.col("tasks"), F.col("v")).alias("u")).collect()
    assert [r["i"] for r in free if r["u"]] == [4]


def test_cached_answers_need_all_citations(spark):
    chunks = spark.createDataFrame([(1, "a", "", None, "normal"), (2, "a", "", "t1", "normal")], CHUNKS)
    entries = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (1, 13)], "query_id long, entry_id long")
    cited = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (12, 99)], "entry_id long, chunk_id long")
    asked = spark.createDataFrame([(1, "a", "", [0.0], [], False)], REQUESTS)
    got = access.still_valid(entries, cited, asked, chunks).collect()
    assert sorted(r["entry_id"] for r in got) == [11, 13]


def test_refresh_rewrites_only_touched_workspaces(spark):
    first = [(1, "a", "alpha beta"), (2, "a", "beta"), (3, "b", "beta gamma"), (4, "b", "delta"), (5, "c", "beta x"), (6, "b", "y"), (7, "a", "z")]
    then = [(1, "a", "alpha"), (8, "a", "beta beta"), (9, "a", "u"), (3, "b", "changed but not touched")]
    path = scratch_dir(spark, "t")
    lexical.build_index(spark.createDataFrame(first, "chunk_id long, workspace_id string, content string"), path=path, partitions=3)
    touched = spark.createDataFrame([("a",), ("c",)], "workspace_id string")
    index = lexical.refresh_index(spark, path, spark.createDataFrame(then, "chunk_id long, workspace_id string, content string"), touched)
    now = [r for r in then if r[1] == "a"] + [r for r in first if r[1] == "b"]
    q = spark.createDataFrame([(1, "a", "beta alpha"), (2, "b", "beta"), (3, "c", "beta")], "query_id long, workspace_id string, query string")
    key = lambda r: (r["query_id"], r["bm25_rank"], r["chunk_id"], round(r["score"], 8))
    want = lexical.top_k(lexical.build_index(spark.createDataFrame(now, "chunk_id long, workspace_id string, content string")), q, 5).collect()
    assert want and sorted(map(key, lexical.top_k(index, q, 5).collect())) == sorted(map(key, want))
    # A session that has not written the index declares its table.
    spark.sql(f"DROP TABLE {lexical._table_name(path)}")
    loaded = lexical.top_k(lexical.LexicalIndex.load(spark, path), q, 5).collect()
    assert sorted(map(key, loaded)) == sorted(map(key, want))
