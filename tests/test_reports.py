import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.operators.quantiles import percentiles
from groundwell.plans import cache_eval, grounding_eval, metrics, retrieval_eval
from groundwell.session import scratch_dir
from groundwell.sources import export, files, jsonl


def test_percentiles_equal_numpy(spark):
    rng = random.Random(1)
    groups = {
        "one": [4.25],
        "two": [1.0, 2.0],
        "same": [7.0] * 50,
        "mixed": [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-8, 8) for _ in range(400)],
        "close": [1000 + rng.random() * 1e-9 for _ in range(300)],
        "zeros": [0.0, -0.0, 0.0, 3.5, -2.0],
        "ints": [float(rng.randint(0, 9)) for _ in range(101)],
        None: [5.0, 6.0, 9.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("empty", None), ("one", None)]
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in percentiles(df, ["k"], F.col("v"), probs).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(float(np.percentile(vs, p * 100)), rel=1e-12, abs=1e-12), (k, name)


def test_percentiles_without_keys(spark):
    df = spark.range(1, 101).select(F.col("id").alias("v"))
    assert percentiles(df, [], F.col("v"), {"m": 0.5}).collect()[0]["m"] == 50.5


def test_breakdown_defaults(spark):
    rows = [("chat", "m", 10.0, 5, None, True, None), ("chat", "m", 30.0, None, None, False, "E"), (None, "", None, None, None, None, "")]
    df = spark.createDataFrame(rows, "purpose string, model string, latency_ms double, prompt_tokens long, completion_tokens long, parse_ok boolean, error_type string")
    got = {r["purpose"]: r for r in metrics.call_breakdown(df).collect()}
    chat = got["chat"]
    assert (chat["count"], chat["p50_latency_ms"], chat["avg_prompt_tokens"], chat["avg_completion_tokens"]) == (2, 20.0, 5.0, 0.0)
    assert (chat["parse_failure_rate"], chat["error_count"]) == (50.0, 1)
    none = got["unknown"]
    assert (none["model"], none["p50_latency_ms"], none["p95_latency_ms"], none["parse_failure_rate"], none["error_count"]) == ("unknown", 0.0, 0.0, 0.0, 0)


def test_cache_summary_leaves_out_the_limit(spark):
    rows = [(True, True, "yes", 5.0, 100.0, None), (True, False, "limit", None, 300.0, 40.0), (True, None, "no", 7.0, 500.0, 60.0), (False, True, "yes", 1.0, 1.0, 1.0), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "cache_enabled boolean, cache_hit boolean, cache_verify_result string, cache_verify_ms double, total_ms double, ttft_ms double").withColumn("ws", F.lit("a"))
    r = metrics.cache_summary(df, ["ws"]).first()
    assert (r["enabled_count"], r["hit_count"], r["verify_count"], r["verify_limited_count"], r["verify_hit_share"]) == (3, 1, 2, 1, 100.0)
    assert (r["verify_p50"], r["miss_total_p50"], r["hit_ttft_p50"]) == (6.0, 400.0, None)


def pair_rows(spark, rows):
    return spark.createDataFrame(rows, "id long, kind string, similarity double, verify_same boolean")


def test_sweeps_by_hand(spark):
    s, d = cache_eval.SAME, cache_eval.DIFFERENT
    df = pair_rows(spark, [(1, s, 0.99, True), (2, s, 0.90, True), (3, s, 0.82, None), (4, d, 0.96, False), (5, d, 0.88, True)])
    rows = {r["threshold"]: r for r in cache_eval.sweep(df, (0.85, 0.95, 1.0)).collect()}
    assert rows[0.85]["hit_rate"] == pytest.approx(2 / 3) and rows[0.85]["false_hit_rate"] == 1.0
    assert rows[0.95]["precision"] == 0.5 and rows[0.95]["f1"] == pytest.approx(2 * 0.5 * (1 / 3) / (0.5 + 1 / 3))
    assert rows[1.0]["precision"] is None and rows[1.0]["f1"] is None and rows[1.0]["hit_rate"] == 0.0
    v = {(r["direct_threshold"], r["candidate_threshold"]): r for r in cache_eval.verify_sweep(df, [(0.95, 0.80), (None, 0.80)]).collect()}
    a = v[(0.95, 0.80)]
    assert (a["same_hits"], a["diff_hits"], a["verify_calls"], a["direct_hits_diff"]) == (2, 2, 3, 1)
    b = v[(None, 0.80)]
    assert (b["mode"], b["same_hits"], b["diff_hits"], b["verify_calls"], b["direct_hits_diff"]) == ("always_verify", 2, 1, 5, 0)


def test_recommendation_prefers_the_lower_threshold(spark):
    df = spark.createDataFrame([(0.9, 0.5, 0.0), (0.88, 0.5, 0.0), (0.85, 0.9, 0.1)], "threshold double, hit_rate double, false_hit_rate double")
    assert cache_eval.recommend(df).first()["threshold"] == 0.88
    assert cache_eval.recommend(df.where("false_hit_rate > 0")).collect() == []


def test_sweep_over_one_kind_has_null_rates(spark):
    r = cache_eval.sweep(pair_rows(spark, [(1, cache_eval.SAME, 0.9, None)]), (0.85,)).first()
    assert r["hit_rate"] == 1.0 and r["false_hit_rate"] is None


def test_grounding_fails_open(spark):
    schema = "id long, category string, variant string, repeat int, expected_groundable boolean, top_similarity double, llm_is_groundable boolean, fallback_reason string, llm_confidence double, parse_ok boolean, latency_ms double, prompt_tokens long, completion_tokens long"
    rows = [
        (1, "a", None, None, True, 0.9, True, None, 0.9, True, 10.0, 5, 1),
        (2, "a", None, None, True, 0.1, True, None, 1.0, True, 20.0, None, 1),
        (3, "b", None, None, False, 0.8, False, "llm_error", None, False, None, None, None),
        (4, "b", None, None, False, 0.8, False, None, 0.2, True, 30.0, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    r = grounding_eval.metrics(df, (0.35,)).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5, 0.5)
    assert (r["filter_false_block_rate"], r["llm_call_saving_rate"], r["llm_only_agreement"], r["parse_failure_rate"]) == (0.5, 0.25, 0.75, 0.25)
    assert (r["bucket_08_10"], r["bucket_05_08"], r["mean_latency_ms"]) == (1.0, None, 20.0)
    stats = {s["metric"]: s for s in grounding_eval.repeat_stats(df).collect()}
    assert stats["accuracy"]["n"] == 1 and stats["accuracy"]["stdev"] is None


def test_retrieval_measures_by_hand(spark):
    cases = spark.createDataFrame([(1, "single_doc", True), (2, "distractor", False), (3, "acl_task", False), (4, "out_of_corpus", False)], "query_id long, category string, has_substrings boolean")
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "z")], "query_id long, doc_key string")
    forbidden = spark.createDataFrame([(2, "d"), (3, "s")], "query_id long, doc_key string")
    rows = [
        (1, 1, "x", 0.9, False), (1, 2, "x", 0.8, False), (1, 3, "a", 0.7, True),
        (2, 1, "c", 0.9, False), (2, 2, "d", 0.6, False), (3, 1, "s", 0.5, False), (4, 1, "q", 0.3, False),
    ]
    retrieved = spark.createDataFrame(rows, "query_id long, rank int, doc_key string, similarity double, substring_hit boolean")
    per = {r["query_id"]: r for r in retrieval_eval.per_request(cases, expected, forbidden, retrieved, 2).collect()}
    assert (per[1]["recall_at_k"], per[1]["mrr"], per[1]["hit_at_1"], per[1]["chunk_hit_at_k"]) == (0.5, 0.5, 0.0, 0.0)
    assert per[1]["margin"] == pytest.approx(0.1)
    assert (per[2]["hit_at_1"], per[2]["forbidden_second"], per[2]["forbidden_exposed"], per[2]["acl_leak"]) == (1.0, True, True, False)
    assert (per[3]["recall_at_k"], per[3]["mrr"], per[3]["acl_leak"], per[3]["margin"]) == (0.0, 0.0, True, None)
    assert (per[4]["recall_at_k"], per[4]["mrr"], per[4]["hit_at_1"]) == (None, None, None)
    rolled = {r["category"]: r for r in retrieval_eval.roll_up(retrieval_eval.per_request(cases, expected, forbidden, retrieved, 2)).collect()}
    assert (rolled["overall"]["n"], rolled["overall"]["n_scored"], rolled["overall"]["leak_count"], rolled["overall"]["forbidden_exposed_count"]) == (4, 3, 1, 2)
    assert rolled["out_of_corpus"]["top_similarity_max"] == 0.3 and rolled["overall"]["top_similarity_max"] is None
    assert rolled["distractor"]["forbidden_second_count"] == 1


def lines(spark, name, rows):
    path = scratch_dir(spark, name)
    spark.createDataFrame([(r,) for r in rows], "value string").write.text(path)
    return path


def test_strict_scans_fail_on_the_first_broken_row(spark):
    good = '{"id": "1", "kind": "same_intent", "q1": "a", "q2": "b"}'
    assert jsonl.scan_pairs(spark, lines(spark, "p", [good])).count() == 1
    for bad in ('{"id": "1", "kind": "other", "q1": "a", "q2": "b"}', '{"id": "1", "kind": "same_intent", "q1": "", "q2": "b"}', "{oops"):
        with pytest.raises(Exception):
            jsonl.scan_pairs(spark, lines(spark, "p", [good, bad])).collect()
    case = {"id": "c", "category": "acl_task", "question": "q", "expected_doc_keys": [], "forbidden_doc_keys": [], "access": {"accessible_task_ids": None, "can_view_restricted": True}}
    row = jsonl.scan_cases(spark, lines(spark, "c", [json.dumps(case)])).first()
    assert row["access"]["accessible_task_ids"] is None and row["expected_substrings"] == [] and row["note"] == ""
    for change in ({"category": "x"}, {"question": ""}, {"access": None}):
        with pytest.raises(Exception):
            jsonl.scan_cases(spark, lines(spark, "c", [json.dumps({**case, **change})])).collect()


def test_strict_scans_name_file_and_line_over_splits(spark, tmp_path):
    good = {"id": "1", "kind": "same_intent", "q1": "a question", "q2": "another"}
    rows = [json.dumps({**good, "id": str(i)}) if i % 7 else "  " for i in range(200)]
    for name, bad in (("a", None), ("b", 150), ("c", 3)):
        broken = rows if bad is None else [*rows[: bad - 1], '{"id": "x", "kind": "other", "q1": "a", "q2": "b"}', *rows[bad:], "{oops"]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(broken) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        with pytest.raises(ValueError, match=r"b\.jsonl:150: unknown kind: .*\"x\""):
            jsonl.scan_pairs(spark, str(tmp_path))
        with pytest.raises(ValueError, match=r"c\.jsonl:3: unknown kind"):
            jsonl.scan_pairs(spark, str(tmp_path / "c.jsonl"))
        rules = {"unknown kind": jsonl.F.col("kind").isin(*jsonl.PAIR_KINDS)}
        found = jsonl.broken_lines(spark, str(tmp_path), jsonl.PAIR_SCHEMA, rules).collect()
        assert {(r["file"][-7:], r["line"], r["problem"]) for r in found} == {
            ("b.jsonl", 150, "unknown kind"), ("b.jsonl", 201, "not a JSON record"),
            ("c.jsonl", 3, "unknown kind"), ("c.jsonl", 201, "not a JSON record"),
        }
        assert jsonl.scan_pairs(spark, str(tmp_path / "a.jsonl")).count() == sum(r.strip() != "" for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_event_files_named_by_event(spark, tmp_path):
    (tmp_path / "chat.jsonl").write_text('{"total_ms": 5, "flag_ms": true, "text_ms": "7", "n": 1}\n\n{"total_ms": 7.5}\n{"tot')
    (tmp_path / "ingestion.jsonl").write_text('{"read_ms": null, "result": "FAILED"}\n')
    ev = jsonl.scan_events(spark, str(tmp_path))
    assert {r["event"]: r["n"] for r in ev.groupBy("event").agg(F.count("*").alias("n")).collect()} == {"chat": 2, "ingestion": 1}
    got = [tuple(r) for r in metrics.stage_percentiles(metrics.stage_values(ev)).collect()]
    assert got == [("chat", "total_ms", 6.25, 7.375)]


def test_bad_bytes_become_replacement_characters(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"ok \xff\xfe end")
    row = files.scan_documents(spark, str(tmp_path)).first()
    assert (row["file_bytes"], row["text"]) == (9, "ok �� end")


def test_export_replaces_only_its_version(spark):
    path = scratch_dir(spark, "x")
    schema = "workspace_id string, dataset_version string, original_question string, target_role string, final_answer string, source string, prompt_version string, is_faq boolean, owner_verified boolean"
    row = lambda ws, v, q: (ws, v, q, "qa", "mail a@b.co", "chat", "p", False, False)
    export.export(spark.createDataFrame([row("a", "v1", "one"), row("b", "v1", "two")], schema), path)
    told = export.export(spark.createDataFrame([row("a", "v1", "010-1234-5678"), row("a", "v1", "x")], schema), path)
    assert told == {"record_count": 2, "scrubbed_field_count": 3}
    back = sorted((r["workspace_id"], r["original_question"], r["final_answer"]) for r in spark.read.json(path).collect())
    assert back == [("a", "[PHONE]", "mail [EMAIL]"), ("a", "x", "mail [EMAIL]"), ("b", "two", "mail [EMAIL]")]
    for bad in (row("../a", "v1", "q"), row("a", ".v", "q")):
        with pytest.raises(Exception):
            export.export(spark.createDataFrame([bad], schema), path)


def test_daily_usage_adds_to_the_table(spark):
    df = spark.createDataFrame([("w", "2024-01-01 23:59:59", "m", 1.2), ("w", "2024-01-02 00:00:00", "m", 0.2), ("w", "2024-01-01 00:00:00", "m", 0.2)], "workspace_id string, ts string, embedding_model string, embedding_tokens double").withColumn("ts", F.col("ts").cast("timestamp"))
    first = metrics.daily_usage(df)
    got = sorted((str(r["date"]), float(r["embedding_tokens"])) for r in metrics.daily_usage(df, first).collect())
    assert got == [("2024-01-01", 2.8), ("2024-01-02", 0.4)]


def test_passages_and_phrases_are_found_in_the_text(spark):
    long = "one two three four five six seven eight"
    rows = [(1, f"x {long} y"), (2, f"{long[:-1]} y"), (3, f"pre-{long}post"), (4, "nothing"), (5, None), (6, "two three four five six seven"), (7, f"a\n{long}\nb {long}")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    passages = spark.createDataFrame([(9, long), (8, "zero " + long)], "query_id long, passage string")
    got = retrieval_eval.containing(chunks, passages)
    assert sorted(tuple(r) for r in got.collect()) == [(9, 1), (9, 3), (9, 7)]
    items = spark.createDataFrame([(9, 1, 1), (9, 2, 4), (9, 3, 77), (8, 1, 1), (7, 1, 1)], "query_id long, rank int, chunk_id long")
    phrases = spark.createDataFrame([(9, ["zzz", "two three"]), (8, ["zzz"])], "query_id long, phrases array<string>")
    marked = retrieval_eval.mark_substrings(items, chunks, phrases).collect()
    assert sorted((r["query_id"], r["rank"], r["substring_hit"]) for r in marked) == [(7, 1, False), (8, 1, False), (9, 1, True), (9, 2, False), (9, 3, False)]


def test_passages_of_any_length(spark):
    """Against plain containment, also of words cut at their ends, with anchors looked up and joined."""
    import random

    from groundwell.plans import retrieval_eval

    rng = random.Random(12)
    texts = [" ".join(rng.choices(["ab", "abc", "c", "", "x.", "long\nline", "y"], k=rng.randrange(0, 30))) for _ in range(60)]
    phrases = ["", None, "nowhere", " "]
    for _ in range(120):
        text = rng.choice([t for t in texts if len(t) > 8])
        at = rng.randrange(len(text) - 1)
        phrases.append(text[at : at + rng.randrange(1, 25)])
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    asked = spark.createDataFrame(list(enumerate(phrases)), "query_id long, passage string")
    want = {(q, c) for q, p in enumerate(phrases) if p for c, t in enumerate(texts) if p in t}
    assert {len(p.split(" ")) for p in phrases if p} >= {1, 2, 3, 4, 5, 6, 7}
    for few in (10_000, 0):
        retrieval_eval.FEW, before = few, retrieval_eval.FEW
        found = [(r["query_id"], r["chunk_id"]) for r in retrieval_eval.containing(chunks, asked).collect()]
        retrieval_eval.FEW = before
        assert set(found) == want and len(found) == len(want)


@pytest.mark.parametrize("few", [True, False])
def test_passages_in_few_chunks_move_no_texts(spark, few, monkeypatch):
    """Only chunks that hold an anchor are compared: where they are few, no join deals texts by chunk."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[i : i + 12])) for i in range(28)] + [(None, " ".join(words)), (3, " ".join(words[20:]))]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    asked = spark.createDataFrame([(q, " ".join(words[q : q + 8])) for q in range(0, 30, 3)], "query_id long, passage string")
    if not few:
        monkeypatch.setattr(retrieval_eval, "fits_broadcast", lambda *_: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval_eval.containing(chunks, asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert few == ("hashpartitioning(chunk_id" not in plan)
        # An id without a value meets nothing, and of the two texts of one id each is compared.
        want = sorted((q, c) for q in range(0, 30, 3) for c, t in rows if c is not None and " ".join(words[q : q + 8]) in t)
        assert sorted(tuple(r) for r in found.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
