import random

import pytest
from pyspark.sql import functions as F

from groundwell.functions import commits, rules
from groundwell.operators import budget, cache, grounding, history, hydrate, ingest, prefix, rerank
from groundwell.session import scratch_dir
from groundwell.streaming import ingest as streaming_ingest
from groundwell.streaming import usage


def test_running_total_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BLOCK", 4)
    rng = random.Random(2)
    rows = [(g, p, rng.randint(0, 9)) for g, n in (("a", 37), ("b", 3)) for p in range(n)]
    df = spark.createDataFrame(rows, "g string, p int, v int")
    for newest in (False, True):
        got = {(r["g"], r["p"]): r["t"] for r in prefix.running_total(df, ["g"], "p", "v", "t", newest_first=newest).collect()}
        for g, p, _ in rows:
            assert got[(g, p)] == sum(v for h, q, v in rows if h == g and (q >= p if newest else q <= p))


def kept(sizes, budget_):
    """The truncation rule, message by message."""
    keep, left = set(), budget_
    for i in reversed(range(len(sizes))):
        if sizes[i] > left:
            break
        keep.add(i)
        left -= sizes[i]
    if sum(sizes[:2]) <= 0.3 * budget_:
        keep |= set(range(min(2, len(sizes))))
    return keep


def test_history_keeps_the_newest_and_a_short_first_turn(spark):
    rng = random.Random(4)
    convs = {c: [rng.choice([0, 1, 5, 20, 60, 101]) for _ in range(rng.randint(1, 9))] for c in range(40)}
    rows = [(c, t, "user", "x" * (4 * n)) for c, sizes in convs.items() for t, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {}
    for r in history.truncate(df, budget=100).collect():
        got.setdefault(r["conv_id"], (set(), r["truncated"]))[0].add(r["turn"])
    for c, sizes in convs.items():
        want = kept(sizes, 100)
        assert got.get(c, (set(), None))[0] == want
        if want:
            assert got[c][1] == (len(want) < len(sizes))


def test_turn_numbers(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 3), (1, 5)], "conv_id long, turn int")
    got = [(r["turn_no"], r["is_first_turn"]) for r in history.turns(df).orderBy("turn").collect()]
    assert got == [(1, True), (1, False), (2, False), (2, False), (3, False)]


@pytest.mark.parametrize(
    "reply, error, order, stage",
    [
        ('{"ranking": [3, 1]}', None, [3, 1], "applied"),
        ("[2]", None, [2, 1], "applied"),
        ('{"ranking": [2, 2, 9, 0, true, "1", 1.5, 3]}', None, [2, 3], "applied"),
        ('{"ranking": [true, 8]}', None, [1, 2], "fallback:parse"),
        ("nothing", None, [1, 2], "fallback:parse"),
        ('{"other": [2]}', None, [1, 2], "fallback:parse"),
        ("[3]", "http_429", [1, 2], "fallback:http_429"),
    ],
)
def test_ranking_replies(spark, reply, error, order, stage):
    hits = spark.createDataFrame([(1, r, 100 + r) for r in (1, 2, 3)], "query_id long, rank int, chunk_id long")
    told = spark.createDataFrame([(1, reply, error)], "query_id long, reply string, error string")
    got = rerank.apply_ranking(hits, told, 2).orderBy("new_rank").collect()
    assert [r["rank"] for r in got] == order and {r["stage"] for r in got} == {stage}


def test_ranking_is_skipped_when_there_is_no_choice(spark):
    hits = spark.createDataFrame([(1, 1, 101), (1, 2, 102)], "query_id long, rank int, chunk_id long")
    told = spark.createDataFrame([(1, "[2, 1]", None)], "query_id long, reply string, error string")
    assert {(r["rank"], r["new_rank"], r["stage"]) for r in rerank.apply_ranking(hits, told, 2).collect()} == {(1, 1, "skipped_few"), (2, 2, "skipped_few")}
    assert {r["stage"] for r in rerank.apply_ranking(hits, told, 2, enabled=False).collect()} == {"disabled"}


def test_grounding_stages(spark):
    asked = spark.createDataFrame([(i,) for i in range(1, 7)], "query_id long")
    hits = [(i, 1, "document", None, 0.9) for i in (2, 3, 4, 5)] + [(6, 1, "git_commit", "u1", 0.2), (6, 2, "git_commit", "u2", 0.3), (6, 3, "git_commit", "u3", 0.3), (4, 2, "git_commit", "u9", 0.1)]
    hdf = spark.createDataFrame(hits, "query_id long, rank int, source_type string, author_id string, vector_score double")
    judged = spark.createDataFrame([(2, True, 0.7, None), (3, None, 0.7, None), (4, False, 0.6, None)], "query_id long, is_groundable boolean, confidence double, error string")
    got = {r["query_id"]: tuple(r)[1:] for r in grounding.assess(asked, hdf, judged).collect()}
    assert got[1] == (False, 0.0, "threshold", None, None)
    assert got[2] == (True, 0.7, "llm", None, None)
    assert got[3] == (True, 0.9, "llm_fallback", "parse_error", None)
    assert got[4] == (False, 0.6, "llm", None, "u9")
    assert got[5] == (True, 0.9, "llm_fallback", "llm_error", None)
    assert got[6] == (False, 0.0, "threshold", None, "u2")


def test_namespaces_and_lifetime(spark):
    ns = lambda tasks: cache.namespace(F.lit("w"), F.lit("qa"), tasks, F.lit(False), F.lit("p"), F.lit("m"))
    arr = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    keys = spark.range(1).select(ns(arr("b", "a")).alias("x"), ns(arr("a", "b")).alias("y"), ns(arr()).alias("none"), ns(F.lit(None).cast("array<string>")).alias("any")).first()
    assert keys["x"] == keys["y"] and len({keys["x"], keys["none"], keys["any"]}) == 3
    entries = spark.createDataFrame([(1, "n", [1.0, 0.0], 0.0), (2, "n", [2.0, 0.0], 50.0), (3, "n", [0.9, 0.3], 60.0)], "entry_id long, namespace string, vector array<double>, at double")
    asked = spark.createDataFrame([(1, "n", [1.0, 0.0], 100.0), (2, "n", [1.0, 0.0], 150.0), (3, "n", [0.0, 1.0], 100.0), (4, "o", [1.0, 0.0], 100.0), (5, "n", [1.0, 0.0], 151.0)], "query_id long, namespace string, vector array<double>, at double")
    got = {r["query_id"]: (r["entry_id"], r["outcome"]) for r in cache.lookup(asked, entries, ttl=100.0).collect()}
    # Age equal to the lifetime is still live; equal similarity goes to the older entry.
    assert got == {1: (1, "direct"), 2: (2, "direct"), 3: (None, "miss"), 4: (None, "miss"), 5: (3, "candidate")}
    assert {r["outcome"] for r in cache.lookup(asked.where("query_id = 5"), entries, ttl=100.0, floor=None).collect()} == {"miss"}


def test_entries_stored_after_the_request_are_not_found(spark):
    entries = spark.createDataFrame([(1, "n", [1.0, 0.1], 90.0), (2, "n", [1.0, 0.0], 900.0)], "entry_id long, namespace string, vector array<double>, at double")
    asked = spark.createDataFrame([(1, "n", [1.0, 0.0], 100.0), (2, "n", [1.0, 0.0], 80.0), (3, "n", [1.0, 0.0], 900.0)], "query_id long, namespace string, vector array<double>, at double")
    for small in (True, False):
        got = {r["query_id"]: (r["entry_id"], r["outcome"]) for r in cache.lookup(asked, entries, small_queries=small).collect()}
        assert got == {1: (1, "direct"), 2: (None, "miss"), 3: (2, "direct")}


def test_ranks_have_no_gaps_after_hydration(spark):
    """Seven hits of which the second has no chunk: the model sees six, and its numbers mean those."""
    hits = spark.createDataFrame([(1, k + 1, 10 + k, 0.5) for k in range(7)], "query_id long, rank int, chunk_id long, vector_score double")
    rows = [(c, "document", c, f"text {c}", None) for c in (10, 12, 13, 14, 15, 16)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source_type string, source_id long, content string, owner_name string")
    parents = spark.createDataFrame([(c, f"T{c}", None) for c in range(10, 17)], "source_id long, title string, author_id string").withColumn("source_type", F.lit("document"))
    left = hydrate.hydrate(hits, chunks, parents)
    assert [r["rank"] for r in left.orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6]
    told = spark.createDataFrame([(1, "[2, 6]", None)], "query_id long, reply string, error string")
    got = rerank.apply_ranking(left, told, 3).orderBy("new_rank").collect()
    assert [r["chunk_id"] for r in got] == [12, 16, 10]
    asked = spark.createDataFrame([(1, "q")], "query_id long, query string")
    assert hydrate.rerank_prompts(asked, left).first()["prompt"].count("\n[") == 6
    assert hydrate.contexts(left, 3).first()["context"].count("[") == 3


def test_batches_count_what_was_indexed_before_a_failure(spark):
    rows = [(1, 1, 3, 0, 30, 5, None, None), (1, 2, 4, 1, 40, 6, "E", "analysis"), (1, 3, 9, 9, 90, None, "X", "index")]
    schema = "batch_id long, position long, new_chunks long, skipped_chunks long, input_chars long, provider_tokens long, error_type string, failed_stage string"
    got = ingest.git_batch_summary(spark.createDataFrame(rows, schema)).first()
    assert (got["new_chunk_count"], got["skipped_chunk_count"], got["embedding_input_chars"], got["embedding_provider_tokens"]) == (7, 1, 70, 11)
    assert (got["failed_commit_count"], got["error_type"], got["result"]) == (2, "E", "PARTIAL")


def test_a_batch_that_failed_as_a_whole_counts_nothing(spark):
    rows = [(b, p, 3, 0, 30, 5, 2.5, None, None, kind) for b in (1, 2) for p, kind in ((1, "llm"), (2, "capped"))]
    rows += [(1, 3, 9, 9, 90, 7, 9.0, "X", "index", "llm"), (1, 4, 1, 0, 10, 1, 1.0, "Y", "analysis", "llm")]
    schema = "batch_id long, position long, new_chunks long, skipped_chunks long, input_chars long, provider_tokens long, embed_ms double, error_type string, failed_stage string, analysis string"
    batches = spark.createDataFrame([(1, "w", 8.0, 4, 20.0, None), (2, "w", 1.0, 4, 5.0, "Down")], "batch_id long, workspace_id string, analysis_ms double, analysis_concurrency int, total_ms double, error_type string")
    one, two = ingest.git_batch_summary(spark.createDataFrame(rows, schema), batches).orderBy("batch_id").collect()
    assert (one["new_chunk_count"], one["embed_ms"], one["analysis_llm_count"], one["analysis_capped_count"]) == (7, 6.0, 2, 1)
    assert (one["failed_commit_count"], one["error_type"], one["result"], one["analysis_ms"]) == (2, "X", "PARTIAL", 8.0)
    assert (two["new_chunk_count"], two["embed_ms"], two["analysis_ms"], two["embedding_provider_tokens"]) == (None, None, None, None)
    assert (two["failed_commit_count"], two["error_type"], two["result"], two["total_ms"]) == (2, "Down", "FAILED", 5.0)


def test_document_records_hold_what_was_known_when_a_stage_failed(spark):
    fields = ["read", "chunk", "context", "embed", "store", None]
    docs = [(i, "w", "md", 10, None if s == "read" else "ab\ufffd\ufffd", s, s and "E") for i, s in enumerate(fields)] + [(9, "w", "md", 0, "", None, None)]
    documents = spark.createDataFrame(docs, "doc_id long, workspace_id string, doc_type string, file_bytes long, text string, failure_stage string, error_type string")
    # Called twice and given, called and empty, reused; without contexts in the last place.
    parts = [(0, "12345", "c", 2, False), (1, "123", None, 1, False), (2, "1", "c", 0, True), (3, "1", None, None, None)]
    chunks = spark.createDataFrame([(d, *c) for d in range(6) for c in parts], "doc_id long, chunk_index int, input string, context string, context_calls int, context_reused boolean")
    times = spark.createDataFrame([(5, "read", 1.0), (5, "read", 2.0), (5, "chunk", 4.0), (5, "notify", 8.0), (0, "read", 1.0)], "doc_id long, stage string, ms double")
    records, seen = ingest.observed_records(ingest.document_records(documents, chunks, times, F.sum(F.length("input"))))
    got = {r["doc_id"]: r for r in records.collect()}
    row = lambda i, *names: tuple(got[i][n] for n in names)
    sizes = ("char_count", "chunk_count", "replacement_ratio", "embedding_input_chars", "embedding_provider_tokens")
    assert row(0, *sizes) == (0, 0, None, None, None) and row(1, *sizes) == (4, 0, 0.5, None, None)
    assert row(2, *sizes) == (4, 4, 0.5, None, None) and row(3, *sizes) == (4, 4, 0.5, 10, None)
    assert row(4, *sizes) == row(5, *sizes) == (4, 4, 0.5, 10, 10) and row(9, *sizes) == (0, 0, 0.0, None, None)
    context = ("context_llm_calls", "context_failed", "context_reused", "context_retried")
    assert row(2, *context) == (0, 0, 0, 0) and row(3, *context) == row(5, *context) == (3, 1, 1, 1)
    assert row(5, "read_ms", "chunk_ms", "context_ms", "total_ms") == (3.0, 4.0, None, 15.0)
    assert [got[i]["result"] for i in (0, 1, 2, 3, 4, 5, 9)] == ["FAILED"] * 5 + ["PARSE_WARN", "EMPTY"]
    assert (seen.get["documents"], seen.get["failed"], seen.get["empty"], seen.get["chunks"], seen.get["total_ms"]) == (7, 5, 1, 16, 16.0)


@pytest.mark.parametrize("limit,granted", [(0, 4), (-1, 4), (3, 3)])
def test_daily_budget_without_limit(spark, limit, granted):
    root = scratch_dir(spark, "budget")
    for part in ([(1, "2024-01-01 01:00:00"), (2, "2024-01-01 02:00:00")], [(3, "2024-01-01 03:00:00"), (4, "2024-01-01 04:00:00")]):
        spark.createDataFrame(part, "id long, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    usage.run_daily_budget(stream, f"{root}/out", limit, "at", "id")
    assert spark.read.parquet(f"{root}/out/requests/batch=*").where("acquired").count() == granted


def test_late_usage_counts(spark):
    root = scratch_dir(spark, "usage")
    for day in ("2024-03-09", "2024-03-01", "2024-03-09"):
        row = [(f"{day}T10:00:00", "w", "m", 2.5)]
        spark.createDataFrame(row, "ts string, workspace_id string, embedding_model string, embedding_tokens double").coalesce(1).write.mode("append").json(f"{root}/in")
    usage.run_daily_usage(usage.read_events(spark, f"{root}/in", usage.USAGE_SCHEMA, 1), f"{root}/out")
    got = {str(r["date"]): float(r["embedding_tokens"]) for r in usage.read_daily_usage(spark, f"{root}/out").collect()}
    assert got == {"2024-03-01": 2.5, "2024-03-09": 5.0}


def test_pushes_are_written_once_even_when_late(spark):
    root = scratch_dir(spark, "push")
    for part in ([("w", "a"), ("w", "b"), ("w", "a")], [("w", "b"), ("x", "b")], [("w", "a")]):
        spark.createDataFrame(part, "ws string, h string").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("ws string, h string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    streaming_ingest.run_idempotent(stream, f"{root}/out", ["ws", "h"])
    got = sorted((r["ws"], r["h"]) for r in spark.read.parquet(f"{root}/out/rows/batch=*").collect())
    assert got == [("w", "a"), ("w", "b"), ("x", "b")]


COMMIT = "workspace_id string, commit_hash string, seq long, source_id string, short_hash string, branch_name string, author_name string, author_email string, commit_message string, pushed_at timestamp"


def test_commit_merge_fills_and_replaces(spark):
    old = [("w", "h1", "", "s0", None, "u0", "old", "o@x", "old msg", None)]
    existing = spark.createDataFrame(old, COMMIT.replace("seq long, ", "").replace("author_name string", "author_id string, author_name string"))
    incoming = spark.createDataFrame(
        [
            ("w", "h1", 1, "src1", "s1", "b1", "", None, "new msg", None), ("w", "h1", 2, "src2", "s2", "b2", "ann", "", "", None),
            ("w", "h2", 3, None, None, None, None, "e@x", "m", None), ("w", "h2", 4, "src", "", "b", "bob", "f@x", "m2", None),
            ("v", "h1", 5, None, None, None, "", "none@x", "m", None),
        ],
        COMMIT,
    )
    users = spark.createDataFrame([("e@x", "ue"), ("f@x", "uf"), ("o@x", "uo")], "email string, user_id string")
    got = {(r["workspace_id"], r["commit_hash"]): r for r in ingest.merge_commits(existing, incoming, users).collect()}
    a = got[("w", "h1")]
    assert (a["source_id"], a["short_hash"], a["branch_name"], a["author_id"], a["author_name"], a["author_email"], a["commit_message"], a["created"]) == ("src1", "s0", "b1", "u0", "ann", "o@x", "new msg", False)
    b = got[("w", "h2")]
    assert (b["source_id"], b["author_id"], b["author_name"], b["author_email"], b["commit_message"], b["created"]) == ("src", "ue", "bob", "f@x", "m2", True)
    c = got[("v", "h1")]
    assert (c["author_id"], c["author_name"], c["created"]) == (None, "unknown", True)


def test_budget_orders_by_size_then_position(spark):
    rows = [("b", 0, 5, 1, 9), ("b", 1, 9, 1, 1), ("b", 2, 5, 2, 0), ("b", 3, 5, 2, 0), ("c", 4, 0, 0, 0)]
    df = spark.createDataFrame(rows, "batch string, i int, lines int, files int, diff int")
    got = {r["i"] for r in budget.mark_selected(df, ["batch"], "i", budget.by_size("lines", "files", "diff", "i"), 2, "use").where("use").collect()}
    assert got == {1, 2, 4}
    assert budget.mark_selected(df, ["batch"], "i", [F.asc("i")], 0, "use").where("use").count() == 5


def test_embedding_usage_needs_every_call(spark):
    rows = [(d, i, "x") for d in (1, 2) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, input string")
    reported = F.when((F.max("doc_id") == 1) | (F.max("chunk_index") < 200), F.count(F.lit(1)))
    got = {r["doc_id"]: r for r in ingest.embedding_usage(df, reported).collect()}
    assert (got[1]["calls"], got[1]["estimated_tokens"], got[1]["provider_tokens"]) == (3, 50.0, 250)
    assert got[2]["provider_tokens"] is None


def test_context_is_reused_within_a_document(spark):
    old = spark.createDataFrame([("d", 1, "t", "c1"), ("d", 2, "t", "c2"), ("d", 3, "u", ""), ("e", 4, "v", "c4")], "doc_key string, chunk_id long, content string, context string")
    new = spark.createDataFrame([("d", "t"), ("d", "u"), ("d", "v")], "doc_key string, content string")
    assert {r["content"]: r["context"] for r in ingest.reuse_context(new, old).collect()} == {"t": "c2", "u": None, "v": None}


def test_commit_text_without_email(one):
    c = {k: F.lit(v) for k, v in dict(commit_hash="h", short_hash="s", branch_name="b", author_name="n", author_email="e@x", message="msg").items()}
    c["committed_at"] = F.lit("2024-01-02 03:04:05").cast("timestamp")
    body = one(commits.commit_text(c, F.lit("D")))
    assert body.splitlines()[6:] == ["committed_at: 2024-01-02T03:04:05+00:00", "", "Commit Message:", "msg", "", "Changed Files and Diff:", "D"]
    assert "e@x" not in one(commits.preview(F.lit(body)))


@pytest.mark.parametrize("text, area, risk", [("Fix login page AUTH", "security", "MEDIUM"), ("drop TABLE users", "database", "HIGH"), ("build", "frontend", "LOW"), ("zzz", "general", "LOW")])
def test_commit_keywords(one, text, area, risk):
    assert one(rules.impact_area(F.col("x")), x=text) == area
    assert one(rules.commit_risk(F.col("x")), x=text) == risk


def test_document_keywords_are_distinct_and_capped(one):
    assert one(rules.document_keywords(F.lit("database db api"), F.lit("API"))) == "API, database"
    assert one(rules.document_keywords(F.lit("zzz"), F.lit(None).cast("string"))) == "document, task"
    many = "api task workspace document error risk database upload analysis"
    assert one(rules.document_keywords(F.lit(many), F.lit("md"))).count(",") == 7


def test_file_previews(one):
    assert one(rules.file_preview(F.lit(""), F.lit("x"))) == "No file path was provided."
    assert one(rules.file_preview(F.lit("/a/b.PDF"), F.lit("x"))).startswith("Text preview is not available for extension '.PDF'")
    assert one(rules.file_preview(F.lit("/a/b.Md"), F.lit(" \n"))) == "The file is empty."
    assert one(rules.file_preview(F.lit("/a/b.md"), F.lit(None).cast("string"))) == "File was not found at path: /a/b.md"
    assert one(rules.file_preview(F.lit("/a.b/noext"), F.lit("x"))).startswith("Text preview is not available for extension ''")
    assert one(rules.file_preview(F.lit("/a/.md"), F.lit("x"))).startswith("Text preview is not available for extension ''")


def test_cache_sizes_count_what_was_there_before_eviction(spark, tmp_path):
    from workload import answers

    events = spark.createDataFrame([(i, 4 if i < 50 else 1) for i in range(57)], "event_id long, user_id long")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = answers.cache_lru(spark, str(tmp_path)).groupBy("workspace_id", "stored").count().collect()
    assert sorted(map(tuple, got)) == [("ws0", 50, 40), ("ws1", 7, 7)]
