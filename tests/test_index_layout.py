"""Files, runs and pruning of the lexical index."""

import os
import random

import pytest
from pyspark.sql import functions as F

from groundwell.functions.text import tokenize
from groundwell.operators import fusion, lexical
from groundwell.session import scratch_dir
from groundwell.sources import manifest
from tests.test_search import bm25

CHUNKS = "chunk_id long, workspace_id string, content string"
QUERIES = "query_id long, workspace_id string, query string"


def files(path):
    return {
        os.path.join(d, f) for t in ("postings", "blocks", "counts") for d, _, fs in os.walk(f"{path}/{t}") for f in fs if f.endswith(".parquet")
    }


def ranked(rows):
    return sorted((r["query_id"], r["bm25_rank"], r["chunk_id"], round(r["score"], 8)) for r in rows)


def zipf(seed, n, workspace):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    odds = [1 / (i + 1) for i in range(400)]
    return [(i, workspace(i), " ".join(rng.choices(words, odds, k=rng.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("small", [True, False])
def test_pruned_search_equals_brute_force_and_reads_less(spark, small, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "PAIRS_PER_TASK", 50)
    monkeypatch.setattr(lexical, "SIDE", 2)
    chunks = zipf(1, 1500, lambda i: "a" if i % 5 else "b")
    asked = [
        (1, "a", "w0 w350"), (2, "a", "w1 w2 w300 w300"), (3, "b", "w0 w1"), (4, "a", "w390"), (5, "a", "nothing"), (6, "zz", "w1"), (7, "a", ""),
        (8, "a", "w0 w1 w2 w333"), (9, "a", "w0"),
    ]
    index = lexical.build_index(spark.createDataFrame(chunks, CHUNKS), partitions=4)
    q = spark.createDataFrame(asked, QUERIES)
    got = lexical.top_k(index, q, 5, small_queries=small, prune=True).collect()
    assert ranked(got) == ranked(lexical.top_k(index, q, 5, small_queries=small, prune=False).collect())
    for qid, ws, text in asked[:4]:
        mine = sorted((r for r in got if r["query_id"] == qid), key=lambda r: r["bm25_rank"])
        assert [(r["chunk_id"], pytest.approx(r["score"], abs=1e-8)) for r in mine] == bm25(chunks, ws, text)[:5]
    scored = {r["query_id"]: r["n"] for r in lexical.score(index, q).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    wanted = lexical._wanted(index, lexical.query_terms(q))
    read = lexical.pruned_scores(index, wanted, 5, small).groupBy("query_id").agg(F.count("*").alias("n"))
    read = {r["query_id"]: r["n"] for r in read.collect()}
    assert read[1] < scored[1] / 2 and read[8] < scored[8] / 2 and all(read[i] <= scored[i] for i in scored)


ODD = [
    (1, "a", "Red red blue"), (2, "a", ""), (3, "a", None), (4, "b", "가나다라 가나 red"), (None, "b", "blue"), (5, None, "red"),
    (6, "a", "one two three"),
]


def counted(spark, rows):
    frame = spark.createDataFrame(rows, CHUNKS)
    found = lexical._postings(frame, lexical._sizes(frame), tokenize, None, 3)
    return found, sorted(map(str, (tuple(r) for r in found.select("workspace_id", "chunk_id", "dl", "term", "tf").collect())))


def test_terms_of_single_chunks_are_counted_without_an_aggregate(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ROWS", 2)
    found, rows = counted(spark, ODD)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    by_hand = {1: ["red", "red", "blue"], 2: [], 4: ["가나다라", "가나", "나다", "다라", "가나", "red"], None: ["blue"], 5: ["red"], 6: ["one", "two", "three"]}
    spaces = {i: w for i, w, _ in ODD}
    want = [(spaces[i], i, len(ws), t, ws.count(t) if t else 1) for i, ws in by_hand.items() for t in {*ws, None}]
    assert rows == sorted(map(str, [*want, ("a", 3, None, None, 1)]))
    # With rows that share an id, the others stay as they are, and equally long rows of one id count as one chunk.
    more = [(6, "a", "two two three"), (6, "a", "longer than the others")]
    found, again = counted(spark, ODD + more)
    assert [r for r in again if "'a', 6," not in r] == [r for r in rows if "'a', 6," not in r]
    ours = [("a", 6, 3, "one", 1), ("a", 6, 3, "two", 3), ("a", 6, 3, "three", 2), ("a", 6, 3, None, 2), ("a", 6, 4, None, 1)]
    ours += [("a", 6, 4, t, 1) for t in ("longer", "than", "the", "others")]
    assert [r for r in again if "'a', 6," in r] == sorted(map(str, ours))


def test_long_queries_move_no_postings(spark, monkeypatch):
    """Where bounds leave most blocks in, all chunks are scored in place: no rows by block and term."""
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", 40)
    chunks = zipf(1, 600, lambda i: "a")
    index = lexical.build_index(spark.createDataFrame(chunks, CHUNKS), partitions=4)
    q = spark.createDataFrame([(i, "a", " ".join(f"w{j}" for j in range(i, 40 + i))) for i in range(3)], QUERIES)
    wanted = lexical._wanted(index, lexical.query_terms(q))
    for few in (40, 10_000):
        monkeypatch.setattr(lexical, "BLOCK_PAIRS", few)
        plan = lexical.pruned_scores(index, wanted, 5, True)._jdf.queryExecution().executedPlan().toString()
        assert [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x] == [] and "SortMergeJoin" not in plan
        got = lexical.top_k(index, q, 5, small_queries=True, prune=True).collect()
        assert ranked(got) == ranked(lexical.top_k(index, q, 5, prune=False).collect())


@pytest.mark.parametrize("prune", [None, True])
def test_a_bounded_batch_moves_neither_counts_nor_postings(spark, prune):
    """However large they are: no join rests on their size. Plain top_k, and the candidates of a batch not yet counted."""
    chunks = zipf(2, 300, lambda i: "ab"[i % 2])
    index = lexical.build_index(spark.createDataFrame(chunks, CHUNKS), partitions=4)
    q = spark.createDataFrame([(i, "ab"[i % 2], "w1 w2 w2 w9", [1.0, float(i)]) for i in range(4)], QUERIES + ", vector array<double>")
    vecs = spark.createDataFrame([(c[0], c[1], [1.0, float(c[0])]) for c in chunks], "chunk_id long, workspace_id string, vector array<double>")
    want = ranked(lexical.top_k(index, q, 5, small_queries=False).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lexical.top_k(index, q, 5, prune=prune) if prune else fusion.candidates(q, index, vecs, 5)[1]
        weights = lexical._wanted(index, lexical.query_terms(q), True)
        for frame in (found, weights):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "run#" in x.partition("hashpartitioning(")[2].partition("),")[0]] == []
        assert ranked(found.collect()) == want and len(want) == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("small", [True, False])
def test_pruned_search_of_repeated_and_null_ids(spark, small, monkeypatch):
    """An id may stand for requests in two workspaces, or be null: the blocks of one are not those of the other."""
    monkeypatch.setattr(lexical, "BLOCK", 4)
    index = lexical.build_index(spark.createDataFrame(zipf(3, 400, lambda i: "ab"[i % 2]), CHUNKS), partitions=4)
    q = spark.createDataFrame([(1, "a", "w3 w9"), (1, "b", "w3 w9"), (None, "a", "w2 w40")], QUERIES)
    got = [tuple(r) for r in lexical.top_k(index, q, 6, small_queries=small, prune=True).collect()]
    want = [tuple(r) for r in lexical.top_k(index, q, 6, small_queries=small, prune=False).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) == 12


def test_all_weights_negative(spark):
    # Two of three chunks hold every word: the floor of their workspace lies below zero.
    rows = [(1, "a", "x y"), (2, "a", "x y"), (3, "a", "x y z")]
    index = lexical.build_index(spark.createDataFrame(rows, CHUNKS))
    q = spark.createDataFrame([(1, "a", "x z"), (2, "a", "x")], QUERIES)
    want = ranked(lexical.top_k(index, q, 3, prune=False).collect())
    assert ranked(lexical.top_k(index, q, 3, prune=True).collect()) == want
    assert [w[2] for w in want] == [r[0] for r in bm25(rows, "a", "x z")]


def test_blocks_are_counted_without_a_shuffle(spark):
    path = scratch_dir(spark, "t")
    lexical.build_index(spark.createDataFrame(zipf(2, 300, lambda i: "a"), CHUNKS), path=path, partitions=4)
    by_block = lexical.LexicalIndex.load(spark, path).postings.groupBy("workspace_id", "block", "term", "run", "part").count()
    assert "Exchange" not in by_block._jdf.queryExecution().executedPlan().toString()


def test_buckets_follow_the_bytes_of_text(spark, monkeypatch):
    """A task sorts the postings of one bucket: its text is bounded, whatever the number of partitions asked for."""
    monkeypatch.setattr(lexical, "BUCKET_TEXT", 2_000, raising=False)
    monkeypatch.setattr(lexical, "BLOCK", 4)
    rows = [*zipf(4, 400, lambda i: "ab"[i % 2]), (400, "a", None), (None, "b", "w1"), (401, None, "w1 w2")]
    chunks = spark.createDataFrame(rows, CHUNKS).withColumn("before", F.when(F.col("chunk_id") < 200, F.lit("가나다 w7")))
    q = spark.createDataFrame([(i, "ab"[i % 2], f"w1 w2 w{i} 가나") for i in range(6)], QUERIES)
    for context in (None, "before"):
        size = sum(len((r[2] or "").encode()) for r in rows) + (context is not None) * 200 * (len("가나다 w7".encode()) + 1)
        path = scratch_dir(spark, "t")
        index = lexical.build_index(chunks, path=path, partitions=2, context=context)
        assert index.state["buckets"] == -(-size // 2_000) > 10
        by_bucket = spark.table(lexical._table_name(path)).where("term IS NOT NULL").groupBy(F.input_file_name().alias("f")).agg(F.sum("tf").alias("n"))
        found = {}
        for r in by_bucket.collect():
            bucket = r["f"].rpartition("_")[2].partition(".")[0]
            found[bucket] = found.get(bucket, 0) + r["n"]
        assert len(found) > 8 and max(found.values()) < 0.3 * sum(found.values())
        # The same results as of a few large buckets; a refresh keeps their number.
        again = lexical.refresh_index(spark, path, chunks, spark.createDataFrame([("b",)], "workspace_id string"), context=context)
        assert again.state["buckets"] == index.state["buckets"]
        with monkeypatch.context() as m:
            m.setattr(lexical, "BUCKET_TEXT", 10**9)
            few = lexical.build_index(chunks, partitions=2, context=context)
        want = ranked(lexical.top_k(few, q, 5).collect())
        assert few.state["buckets"] == 2 and len(want) == 30
        assert ranked(lexical.top_k(index, q, 5).collect()) == ranked(lexical.top_k(again, q, 5).collect()) == want


def test_files_do_not_grow_with_workspaces(spark):
    path = scratch_dir(spark, "t")
    # A third of all chunks lies in one workspace, the others in ten thousand.
    rows = spark.range(15_000).select(
        F.col("id").alias("chunk_id"),
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 10_000)).alias("workspace_id"),
        F.concat(F.lit("term"), F.col("id") % 50, F.lit(" all")).alias("content"),
    )
    index = lexical.build_index(rows, path=path, partitions=4, segments=8)
    assert index.state["own"] == ["big"]
    # Shared segments and the own one, four buckets each.
    assert sum(f.startswith(f"{path}/postings") for f in files(path)) <= 9 * 4
    q = spark.createDataFrame([(1, "s7", "term7"), (2, "big", "term3")], QUERIES)
    found = index.asked_by(q).postings.inputFiles()
    assert {os.path.basename(os.path.dirname(f)).partition("-")[0] for f in found} == {"part=w1", "part=" + segment(spark, index, "s7")}
    assert {r["chunk_id"] % 50 for r in lexical.top_k(index, q, 3).where("query_id = 2").collect()} == {3}


def segment(spark, index, space):
    row = spark.createDataFrame([(space,)], "workspace_id string").select(lexical._segment(index.state).alias("s")).first()
    return row["s"]


def test_refresh_leaves_files_alone_and_compaction_drops_dead_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "DELTAS", 2)
    path = scratch_dir(spark, "t")
    now = {r[0]: r for r in zipf(3, 240, lambda i: f"s{i % 12}")}
    q = spark.createDataFrame([(i, f"s{i}", "w0 w1 w5 fresh") for i in range(12)], QUERIES)

    def frame():
        return spark.createDataFrame(list(now.values()), CHUNKS)

    def expected():
        return ranked(lexical.top_k(lexical.build_index(frame(), partitions=2), q, 5).collect())

    lexical.build_index(frame(), path=path, partitions=3, segments=4)
    states = []
    for step in range(3):
        before = files(path)
        for i in list(now):
            if now[i][1] == f"s{step}":
                now[i] = (i, f"s{step}", f"fresh {step} " + now[i][2])
        if step == 1:
            now = {i: r for i, r in now.items() if r[1] != "s9"}  # all of it goes
            # And one grows beyond the share.
            now |= {1000 + i: (1000 + i, "s1", "w0 fresh" + " w1" * (i % 3)) for i in range(300)}
        touched = spark.createDataFrame([(f"s{step}",), ("s9",)], "workspace_id string")
        index = lexical.refresh_index(spark, path, frame(), touched)
        assert before <= files(path)
        want = expected()
        assert ranked(lexical.top_k(index, q, 5, prune=step == 1).collect()) == want
        states.append(index.state)
    assert states[1]["own"] == ["s1"] and len(states[1]["corpus"]) == 3
    # The third refresh was one too many: all rows went to their segments, and no dead row is left.
    assert len(states[2]["corpus"]) == 1 and not any(p.startswith("d-") for p in states[2]["parts"])
    live = index.postings.select("workspace_id", "run").distinct().collect()
    assert len(live) == len({r["workspace_id"] for r in live}) == 11
    assert sorted(r["term"] for r in index.terms.where("workspace_id = 's9'").collect()) == []
    lexical.clean_index(spark, path, keep=1)
    assert len(manifest.names(spark, path)) == 1
    # A session that has not written the index declares its table.
    spark.sql(f"DROP TABLE {lexical._table_name(path)}")
    assert ranked(lexical.top_k(lexical.LexicalIndex.load(spark, path), q, 5).collect()) == want


def test_a_failed_refresh_changes_nothing(spark):
    path = scratch_dir(spark, "t")
    rows = spark.createDataFrame([(1, "a", "alpha"), (2, "a", "beta"), (3, "a", "c")], CHUNKS)
    lexical.build_index(rows, path=path)
    q = spark.createDataFrame([(1, "a", "alpha beta")], QUERIES)
    want = ranked(lexical.top_k(lexical.LexicalIndex.load(spark, path), q, 5).collect())
    broken = lambda c: F.when(F.lit(True), F.raise_error(F.lit("no tokens"))).otherwise(F.split(c, " "))
    with pytest.raises(Exception, match="no tokens"):
        lexical.refresh_index(spark, path, rows, rows.select("workspace_id"), broken)
    assert ranked(lexical.top_k(lexical.LexicalIndex.load(spark, path), q, 5).collect()) == want


def test_empty_corpus(spark):
    rows = spark.createDataFrame([], CHUNKS)
    path = scratch_dir(spark, "t")
    index = lexical.build_index(rows, path=path)
    q = spark.createDataFrame([(1, "a", "alpha")], QUERIES)
    assert lexical.top_k(index, q, 5, prune=True).collect() == lexical.top_k(index, q, 5).collect() == []
    then = spark.createDataFrame([(1, "a", "alpha"), (2, "a", "b"), (3, "a", "c")], CHUNKS)
    index = lexical.refresh_index(spark, path, then, then.select("workspace_id"))
    assert [r["chunk_id"] for r in lexical.top_k(index, q, 5, prune=True).collect()] == [1]
