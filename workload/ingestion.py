"""Ingest queries: replace, upsert, merge, reuse, requests, budgets, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions import text as t
from groundwell.functions import vector as V
from groundwell.operators import budget, ingest
from groundwell.session import scratch_dir
from groundwell.sources.bucketed import BucketTable
from groundwell.sources import export, files, jsonl
from workload import bindings as b

# Fixed by the query: a moment to stamp rows with.
STAMP = "2024-02-01 00:00:00"


def _chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    return b.chunks(spark, sf).select("workspace_id", "source_type", (F.col("chunk_id") % 97).alias("source_id"), "chunk_id", "content")


def chunk_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Odd chunks of low numbered sources come in anew; all others are the table."""
    rows = _chunk_table(spark, sf)
    old = rows.where((F.col("chunk_id") % 2 == 0) | (F.col("source_id") >= 40))
    new = rows.where((F.col("chunk_id") % 2 == 1) & (F.col("source_id") < 40)).withColumn("workspace_id", F.lit("ws0"))
    keys = ["workspace_id", "source_type", "source_id"]
    table = BucketTable.create(old.withColumn("workspace_id", F.lit("ws0")), scratch_dir(spark, "chunk-table"), keys, 16)
    merged = table.replace(new.withColumn("source_type", F.lit("document"))).read()
    return merged.select("workspace_id", "source_type", "source_id", "chunk_id", F.md5("content").alias("content_md5"))


def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of even ids replace those of full tens, several versions per id; then every eleventh id
    is deleted. Both read and write the buckets of their own ids only."""
    v = b.table(spark, sf, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("vector"), "label")
    old = v.where("vec_id % 3 <> 0 OR vec_id % 2 = 1").select(F.col("vec_id").alias("id"), "vector")
    new = v.where("vec_id % 2 = 0").select((F.col("vec_id") - F.col("vec_id") % 10).alias("id"), "vector", F.col("vec_id").alias("version"))
    gone = v.where("vec_id % 11 = 0").select(F.col("vec_id").alias("id"))
    table = BucketTable.create(old, scratch_dir(spark, "vector-table"), ["id"], 16)
    table = table.update(new, lambda kept, rows: ingest.upsert_latest(kept, rows, "id", "version")).delete(gone)
    return table.read().select("id", F.round(V.norm(F.col("vector")), 6).alias("norm"), F.round(F.get("vector", F.lit(0)), 6).alias("x0"))


def context_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Old and new chunks by text; documents share a key, so copies find their context."""
    docs = b.table(spark, sf, "documents").select((F.col("doc_id") % 5).alias("doc_key"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    old = docs.where("chunk_id % 4 <> 3").withColumn("context", F.when(F.col("chunk_id") % 6 != 0, F.concat(F.lit("ctx-"), F.col("chunk_id"))))
    return ingest.reuse_context(docs.where("chunk_id % 4 >= 2"), old).select("doc_key", "chunk_id", "content_sha1", "context", "reused")


def index_skip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commits to index; those of indexed customers are skipped and counted."""
    o = b.table(spark, sf, "orders").select(F.concat(F.lit("ws"), F.col("o_custkey") % 4).alias("workspace_id"), F.col("o_custkey").alias("source_id"))
    indexed = b.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("ws"), F.col("c_custkey") % 4).alias("workspace_id"), F.col("c_custkey").alias("source_id"))
    fresh, known = ingest.split_indexed(o, indexed, ["workspace_id", "source_id"])
    both = fresh.withColumn("skipped", F.lit(0)).unionByName(known.withColumn("skipped", F.lit(1)))
    return both.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("total"), F.sum("skipped").alias("skipped"))


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commit arrivals: three orders share a hash, some fields are empty."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return b.table(spark, sf, "orders").select(
        F.lit("ws0").alias("workspace_id"),
        F.sha1(F.floor(k / 3).cast("string")).alias("commit_hash"),
        k.alias("seq"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("src-"), c % 7)).alias("source_id"),
        F.when(k % 5 < 3, F.left(F.sha1(F.floor(k / 3).cast("string")), F.lit(7))).alias("short_hash"),
        F.when(k % 6 < 2, F.concat(F.lit("b"), k % 3)).alias("branch_name"),
        F.when(k % 3 != 1, F.concat(F.lit("n"), c)).alias("author_name"),
        F.when(k % 7 != 0, F.concat(F.lit("Customer#"), F.lpad(c.cast("string"), 9, "0"))).alias("author_email"),
        F.concat(F.lit("msg "), F.col("o_orderpriority")).alias("commit_message"),
        F.when(k % 8 != 0, F.col("o_orderdate")).alias("pushed_at"),
    )


def _known_commits(commits: DataFrame) -> DataFrame:
    return commits.where("seq % 9 = 0").select(
        "workspace_id", "commit_hash", F.lit("").alias("source_id"), F.lit(None).cast("string").alias("short_hash"),
        F.when(F.col("seq") % 2 == 0, "main").alias("branch_name"), F.lit("u-old").alias("author_id"), F.lit("old").alias("author_name"),
        F.lit(None).cast("string").alias("author_email"), F.lit("old message").alias("commit_message"), F.col("pushed_at"),
    )


def commit_merge(spark: SparkSession, sf: str) -> DataFrame:
    commits = _commits(spark, sf)
    users = b.table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_name").alias("email"), F.concat(F.lit("u"), F.col("c_custkey")).alias("user_id"))
    return ingest.merge_commits(_known_commits(commits), commits, users)


def analysis_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Stored analyses of some customers; new ones replace or join them."""
    c = b.table(spark, sf, "customer")
    old = c.where("c_custkey % 2 = 0 OR c_custkey % 3 <> 0").select(F.col("c_custkey").alias("commit_id"), F.lit("old").alias("summary"), F.lit("LOW").alias("risk_level"), F.lit("PENDING").alias("index_status"), F.lit(None).cast("timestamp").alias("analyzed_at"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("commit_id"), F.col("c_mktsegment").alias("summary"), F.lit("HIGH").alias("risk_level"))
    out = ingest.upsert_analysis(old, new, F.lit(STAMP).cast("timestamp"))
    return out.withColumn("analyzed_at", F.date_format("analyzed_at", "yyyy-MM-dd"))


def _batch_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as one batch of commits."""
    k = F.col("o_orderkey")
    return b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("batch_id"), k.alias("position"),
        F.when(k % 5 != 0, k % 4).otherwise(0).alias("new_chunks"), F.when(k % 5 == 0, k % 3).otherwise(0).alias("skipped_chunks"),
        (k % 1000).alias("input_chars"), F.when((F.col("o_custkey") % 2 == 0) | (k % 6 != 0), k % 300).alias("provider_tokens"),
        F.when((F.col("o_custkey") % 5 == 0) | ((F.col("o_custkey") % 5 == 1) & (k % 2 == 0)), F.concat(F.lit("E"), k % 3)).alias("error_type"),
        F.when(k % 7 < 3, "analysis").otherwise("index").alias("failed_stage"),
        (k % 40).cast("double").alias("embed_ms"), F.when(k % 9 == 0, "capped").when(k % 9 < 6, "llm").alias("analysis"),
    )


def git_batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.git_batch_summary(_batch_commits(spark, sf)).drop("embed_ms", "analysis_llm_count", "analysis_capped_count")


def git_batch_records(spark: SparkSession, sf: str) -> DataFrame:
    """With the batches' own times; every eleventh batch failed as a whole."""
    c = F.col("c_custkey")
    batches = b.table(spark, sf, "customer").select(
        c.alias("batch_id"), F.concat(F.lit("ws"), c % 4).alias("workspace_id"), (c % 60).cast("double").alias("analysis_ms"),
        (c % 3 + 1).alias("analysis_concurrency"), (c % 900).cast("double").alias("total_ms"), F.when(c % 11 == 0, "Broken").alias("error_type"),
    )
    return ingest.git_batch_summary(_batch_commits(spark, sf), batches)


def llm_budget_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Commits of a customer that get a model call: the ten largest, and the first ten."""
    k = F.col("o_orderkey")
    rows = b.table(spark, sf, "orders").select("o_custkey", "o_orderkey", (k % 50).alias("lines"), (k % 7).alias("files"), (k % 900).alias("diff_length"))
    big = budget.mark_selected(rows, ["o_custkey"], "o_orderkey", budget.by_size("lines", "files", "diff_length", "o_orderkey"), 5, "by_size")
    both = budget.mark_selected(big, ["o_custkey"], "o_orderkey", [F.asc("o_orderkey")], 5, "by_order")
    return both.select("o_custkey", "o_orderkey", "by_size", "by_order")


def verify_daily_budget(spark: SparkSession, sf: str) -> DataFrame:
    """The first 100 verifications of a day are made, the others marked `limit`."""
    e = b.table(spark, sf, "events").select("event_id", "ts", F.to_date("ts").alias("day"))
    marked = budget.mark_selected(e, ["day"], "event_id", [F.asc("ts"), F.asc("event_id")], 100, "acquired")
    return marked.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count_if("acquired").alias("acquired"), F.count_if(~F.col("acquired")).alias("limited"),
        F.max(F.when(F.col("acquired"), F.col("event_id"))).alias("last_acquired"),
    )


def ingest_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as requests: named ones that exist keep their row, the others are registered."""
    i = F.col("doc_id")
    asked = b.table(spark, sf, "documents").select(
        i.alias("request_id"), F.concat(F.lit("ws"), i % 4).alias("workspace_id"),
        F.when(i % 3 == 0, "").when(i % 3 == 1, F.concat(F.lit("s"), i % 9)).alias("source_id"),
        F.when(i % 2 == 0, F.concat(F.lit("d"), i % 5)).alias("data_source_id"),
        F.when(i % 4 != 0, F.concat(F.lit("doc-"), F.floor(i / 2))).alias("document_id"),
        F.when(i % 5 == 0, F.concat(F.lit("task-"), i % 3)).alias("task_id"),
        F.concat(F.lit("t"), i).alias("title"), F.col("lang").alias("doc_type"), F.concat(F.lit("/f/"), i).alias("file_path"),
        F.when(i % 7 == 0, "restricted").alias("sensitivity_level"),
    )
    known = b.table(spark, sf, "pages").select(
        F.concat(F.lit("doc-"), F.col("page_id")).alias("id"), F.lit("ws0").alias("workspace_id"), F.lit("s0").alias("source_id"),
        F.when(F.col("page_id") % 2 == 0, "task-9").alias("task_id"), F.col("url").alias("title"), F.lit("html").alias("doc_type"),
        F.lit("/p").alias("file_path"), F.lit("COMPLETED").alias("analysis_status"), F.lit(STAMP).cast("timestamp").alias("created_at"),
    )
    accepted, rejected = ingest.split_without_source(asked)
    docs, tasks = ingest.register_documents(known, accepted, F.lit(STAMP).cast("timestamp"))
    again = ingest.retryable(docs, tasks.where("request_id % 8 = 1").select(F.col("document_id").alias("id")))
    marks = ingest.with_access_defaults(tasks.select(F.lit("document").alias("source_type"), F.col("document_id").alias("source_id"), "request_id"))
    snap = ingest.snapshot_access(marks, tasks.groupBy(F.lit("document").alias("source_type"), F.col("document_id").alias("source_id")).agg(F.max("task_id").alias("task_id"), F.max("sensitivity_level").alias("sensitivity_level")))
    sizes = lambda df, name, *cols: df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), F.concat_ws("|", *cols).alias("what"), "n")
    return (
        sizes(docs, "documents", "analysis_status", "workspace_id")
        .unionByName(sizes(tasks, "tasks", "workspace_id", "task_id", "sensitivity_level"))
        .unionByName(sizes(rejected, "rejected", "workspace_id"))
        .unionByName(sizes(again, "retry", "doc_type"))
        .unionByName(sizes(snap, "snapshot", "task_id", "sensitivity_level"))
    )


def scan_text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as text files and read back whole."""
    path = scratch_dir(spark, "files")
    b.table(spark, sf, "pages").select("html").write.mode("overwrite").text(path, lineSep="\n")
    found = files.scan_documents(spark, path, "part-*")
    return found.agg(F.sum("file_bytes").alias("bytes"), F.sum(F.length("text")).alias("chars"))


def scan_events_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended as JSON lines among broken and blank ones, and read back."""
    path = scratch_dir(spark, "events")
    e = b.table(spark, sf, "events").select(F.col("event_type").alias("event"), "event_id", "user_id", F.col("value").alias("latency_ms"), "props")
    jsonl.append_events(e, path)
    e.where("event_id % 100 = 0").select("event", F.lit('{"broken": ').alias("value")).write.mode("append").partitionBy("event").text(path)
    e.where("event_id % 100 = 1").select("event", F.lit(" ").alias("value")).write.mode("append").partitionBy("event").text(path)
    rec = F.col("record")
    return jsonl.scan_events(spark, path).groupBy("event").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.try_variant_get(rec, "$.event_id", "long")).alias("ids"),
        F.round(F.sum(F.try_variant_get(rec, "$.latency_ms", "double")), 2).alias("latency_ms"),
    )


def scan_eval_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records with a key of the wrong type here and there: only that value is lost."""
    path = scratch_dir(spark, "records")
    d = b.table(spark, sf, "conversations")
    i = F.col("conv_id") * 100 + F.col("turn")
    as_text = d.select(
        F.when(i % 10 == 3, F.lit("not json")).otherwise(
            F.concat(F.lit('{"id": '), i, F.lit(', "role": "'), F.col("role"), F.lit('", "n": '), F.when(i % 10 == 4, F.lit('"many"')).otherwise((i % 50).cast("string")), F.lit("}"))
        ).alias("value")
    )
    as_text.write.mode("overwrite").text(path)
    return jsonl.scan_records(spark, path, "id long, role string, n long, missing double")


def scan_cases_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as retrieval cases and question pairs, written and read strictly."""
    root = scratch_dir(spark, "cases")
    i = F.col("item_id")
    cat = F.get(F.array(*map(F.lit, jsonl.CASE_CATEGORIES)), (i % 6).cast("int"))
    cases = b.table(spark, sf, "benchmark").select(
        i.cast("string").alias("id"), cat.alias("category"), F.col("text").alias("question"),
        F.array(F.concat(F.lit("doc-"), i)).alias("expected_doc_keys"), F.array().cast("array<string>").alias("forbidden_doc_keys"),
        F.struct(F.when(i % 2 == 0, F.array(F.lit("task-1"))).alias("accessible_task_ids"), (i % 3 == 0).alias("can_view_restricted")).alias("access"),
        F.when(i % 4 == 0, F.array(F.left("text", F.lit(5)))).alias("expected_substrings"),
    )
    jsonl.save_records(cases, f"{root}/cases")
    pairs = b.table(spark, sf, "benchmark").select(i.cast("string").alias("id"), F.when(i % 2 == 0, "same_intent").otherwise("different_intent").alias("kind"), F.col("text").alias("q1"), F.reverse("text").alias("q2"))
    jsonl.save_records(pairs, f"{root}/pairs")
    read = jsonl.scan_cases(spark, f"{root}/cases").select(
        F.lit("case").alias("kind"), "id", F.col("category").alias("label"), F.size("expected_substrings").alias("n"), F.size("access.accessible_task_ids").alias("m"), F.col("access.can_view_restricted").alias("flag"),
    )
    pair = jsonl.scan_pairs(spark, f"{root}/pairs").select(F.lit("pair").alias("kind"), "id", F.col("kind").alias("label"), F.length("q1").alias("n"), F.length("q2").alias("m"), (F.col("q1") == F.reverse("q2")).alias("flag"))
    return read.unionByName(pair)


def scan_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as manifests of fifty entries, each one JSON array in a file of its own."""
    path = scratch_dir(spark, "manifest")
    i = F.col("doc_id")
    entry = F.struct(
        F.concat(F.lit("doc-"), i).alias("doc_key"), F.lit("f.md").alias("file"), F.concat(F.lit("Doc "), F.col("source")).alias("title"),
        F.lit("md").alias("document_type"), F.when(i % 3 == 0, "task-1").alias("task_id"),
        F.when(i % 7 == 0, "restricted").otherwise("normal").alias("sensitivity_level"), F.col("lang").alias("topic"),
    )
    arrays = b.table(spark, sf, "documents").groupBy(F.floor(i / 50).alias("block")).agg(
        F.to_json(F.collect_list(entry), {"ignoreNullFields": "false"}).alias("value")
    )
    arrays.repartition("block").write.mode("overwrite").partitionBy("block").text(path)
    return jsonl.scan_manifest(spark, f"{path}/block=*").select("doc_key", "title", "task_id", "sensitivity_level", "topic", "note")


def _training(spark: SparkSession, sf: str) -> DataFrame:
    """A user message and the assistant message after it as one record."""
    c = b.table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min_by(F.struct("role", "text"), "text").alias("m"))
    ask = c.where("m.role = 'user'").select("conv_id", "turn", F.col("m.text").alias("original_question"))
    answer = c.where("m.role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("m.text").alias("final_answer"))
    i = F.col("conv_id")
    return ask.join(answer, ["conv_id", "turn"]).select(
        F.concat(F.lit("ws"), i % 3).alias("workspace_id"), F.concat(F.lit("v1."), i % 2).alias("dataset_version"), "original_question",
        F.get(F.array(*map(F.lit, export.ROLES)), (i % 6).cast("int")).alias("target_role"), "final_answer",
        F.get(F.array(*map(F.lit, export.ORIGINS)), (i % 3).cast("int")).alias("source"), F.lit("persona-v1").alias("prompt_version"),
        (i % 2 == 0).alias("is_faq"), (i % 5 == 0).alias("owner_verified"),
    )


def training_export(spark: SparkSession, sf: str) -> DataFrame:
    """Exported twice, then read back with the counts the export returned."""
    path = scratch_dir(spark, "export")
    records = _training(spark, sf)
    export.export(records, path)
    told = export.export(records.where("workspace_id = 'ws1'"), path)
    back = spark.read.json(path)
    return back.groupBy("workspace_id", "dataset_version").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_faq").alias("faq"), F.sum(F.length("original_question")).alias("q_chars"),
        F.sum(F.length("final_answer")).alias("a_chars"),
    ).withColumn("again", F.lit(told["record_count"])).withColumn("again_hits", F.lit(told["scrubbed_field_count"]))


def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses as names: which of their parts may be path components."""
    parts = b.table(spark, sf, "pages").select("page_id", F.posexplode_outer(F.split("url", "/")).alias("pos", "name"))
    fine, broken = jsonl.quarantine(parts, {"unsafe name": t.safe_name(F.col("name"))})
    return fine.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit(None).cast("string")).unionByName(
        broken.groupBy("pos", "problem").agg(F.count(F.lit(1)).alias("n"))
    )


QUERIES = {
    f.__name__: f
    for f in (
        chunk_replace, vector_upsert, context_reuse, index_skip, commit_merge, analysis_upsert, git_batch_summary, git_batch_records, llm_budget_selection,
        verify_daily_budget, ingest_requests, scan_text_files, scan_events_jsonl, scan_eval_records, scan_cases_strict, scan_manifest, training_export, safe_names,
    )
}

from workload.texts import TOKEN_COUNT, _scrub_sql  # noqa: E402

COMMITS = """a AS (SELECT 'ws0' AS workspace_id, sha1((o_orderkey // 3)::VARCHAR) AS commit_hash, o_orderkey AS seq,
  CASE o_orderkey % 4 WHEN 1 THEN 'src-' || (o_custkey % 7) END AS source_id,
  CASE WHEN o_orderkey % 5 < 3 THEN sha1((o_orderkey // 3)::VARCHAR)[:7] END AS short_hash,
  CASE WHEN o_orderkey % 6 < 2 THEN 'b' || (o_orderkey % 3) END AS branch_name,
  CASE WHEN o_orderkey % 3 <> 1 THEN 'n' || o_custkey END AS author_name,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') END AS author_email,
  'msg ' || o_orderpriority AS commit_message, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderdate END AS pushed_at FROM orders),
known AS (SELECT workspace_id, commit_hash, CASE WHEN seq % 2 = 0 THEN 'main' END AS branch_name, pushed_at FROM a WHERE seq % 9 = 0),
batch AS (SELECT workspace_id, commit_hash, arg_min(source_id, seq) FILTER (source_id IS NOT NULL) AS s, arg_min(short_hash, seq) FILTER (short_hash IS NOT NULL) AS h,
  arg_min(branch_name, seq) FILTER (branch_name IS NOT NULL) AS br, arg_max(author_name, seq) FILTER (author_name IS NOT NULL) AS n,
  arg_max(author_email, seq) FILTER (author_email IS NOT NULL) AS e, arg_max(commit_message, seq) AS m, arg_max(pushed_at, seq) FILTER (pushed_at IS NOT NULL) AS p,
  arg_min(struct_pack(e := author_email), seq).e AS first_email FROM a GROUP BY 1, 2)"""

ASKED = """asked AS (SELECT doc_id AS request_id, 'ws' || (doc_id % 4) AS workspace_id,
    coalesce(CASE WHEN doc_id % 3 = 1 THEN 's' || (doc_id % 9) END, CASE WHEN doc_id % 2 = 0 THEN 'd' || (doc_id % 5) END) AS source_id,
    CASE WHEN doc_id % 4 <> 0 THEN 'doc-' || (doc_id // 2) ELSE sha1(doc_id::VARCHAR) END AS id,
    CASE WHEN doc_id % 5 = 0 THEN 'task-' || (doc_id % 3) END AS task_id, lang AS doc_type,
    CASE WHEN doc_id % 7 = 0 THEN 'restricted' ELSE 'normal' END AS sens FROM documents),
ok AS (SELECT * FROM asked WHERE source_id IS NOT NULL),
known AS (SELECT 'doc-' || page_id AS id, 'ws0' AS workspace_id, CASE WHEN page_id % 2 = 0 THEN 'task-9' END AS task_id, 'html' AS doc_type, 'COMPLETED' AS analysis_status FROM pages),
docs AS (SELECT * FROM known UNION ALL
  SELECT id, arg_min(workspace_id, request_id), arg_min(struct_pack(x := task_id), request_id).x, arg_min(doc_type, request_id), 'PENDING' FROM ok WHERE id NOT IN (SELECT id FROM known) GROUP BY 1),
tasks AS (SELECT request_id, o.id, o.workspace_id, coalesce(o.task_id, d.task_id) AS task_id, sens FROM ok o JOIN docs d USING (id)),
marks AS (SELECT id, max(task_id) AS task_id, max(sens) AS sens FROM tasks GROUP BY 1)"""

ORACLE = {
    "chunk_replace": """WITH r AS (SELECT 'ws0' AS workspace_id, CASE doc_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'git_commit' WHEN 2 THEN 'db_schema' ELSE 'owner_answer' END AS st, doc_id % 97 AS source_id, doc_id AS chunk_id, md5(text) AS content_md5 FROM documents),
      n AS (SELECT workspace_id, 'document' AS source_type, source_id, chunk_id, content_md5 FROM r WHERE chunk_id % 2 = 1 AND source_id < 40),
      o AS (SELECT workspace_id, st AS source_type, source_id, chunk_id, content_md5 FROM r WHERE chunk_id % 2 = 0 OR source_id >= 40)
      SELECT * FROM n UNION ALL SELECT * FROM o WHERE (source_type, source_id) NOT IN (SELECT source_type, source_id FROM n)""",
    "vector_upsert": """WITH n AS (SELECT vec_id - vec_id % 10 AS id, arg_max(embedding, vec_id)::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1),
      m AS (SELECT * FROM n UNION ALL SELECT vec_id, embedding::DOUBLE[] FROM embeddings WHERE (vec_id % 3 <> 0 OR vec_id % 2 = 1) AND vec_id NOT IN (SELECT id FROM n))
      SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1], 6) AS x0 FROM m WHERE id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 11 = 0)""",
    "context_reuse": """WITH d AS (SELECT doc_id % 5 AS doc_key, doc_id AS chunk_id, sha1(text) AS content_sha1 FROM documents),
      o AS (SELECT doc_key, content_sha1, arg_max('ctx-' || chunk_id, chunk_id) AS context FROM d WHERE chunk_id % 4 <> 3 AND chunk_id % 6 <> 0 GROUP BY 1, 2)
      SELECT d.doc_key, chunk_id, d.content_sha1, context, context IS NOT NULL AS reused FROM d LEFT JOIN o ON o.doc_key = d.doc_key AND o.content_sha1 = d.content_sha1 WHERE chunk_id % 4 >= 2""",
    "index_skip": """SELECT 'ws' || (o_custkey % 4) AS workspace_id, count(*) AS total, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) AS skipped FROM orders GROUP BY 1""",
    "commit_merge": f"""WITH {COMMITS},
      u AS (SELECT c_name AS email, 'u' || c_custkey AS user_id FROM customer WHERE c_custkey % 3 <> 0)
      SELECT b.workspace_id, b.commit_hash, coalesce(b.s, CASE WHEN k.commit_hash IS NOT NULL THEN '' END) AS source_id, b.h AS short_hash, coalesce(k.branch_name, b.br) AS branch_name,
        CASE WHEN k.commit_hash IS NOT NULL THEN 'u-old' ELSE u.user_id END AS author_id,
        coalesce(b.n, CASE WHEN k.commit_hash IS NOT NULL THEN 'old' END, 'unknown') AS author_name, b.e AS author_email, b.m AS commit_message, coalesce(b.p, k.pushed_at) AS pushed_at,
        k.commit_hash IS NULL AS created FROM batch b LEFT JOIN known k ON k.commit_hash = b.commit_hash LEFT JOIN u ON u.email = b.first_email""",
    "analysis_upsert": """SELECT c_custkey AS commit_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'old' END AS summary, CASE WHEN c_custkey % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level,
      CASE WHEN c_custkey % 3 = 0 THEN 'COMPLETED' ELSE 'PENDING' END AS index_status, CASE WHEN c_custkey % 3 = 0 THEN '2024-02-01' END AS analyzed_at FROM customer""",
    "git_batch_summary": """WITH c AS (SELECT o_custkey AS batch_id, o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 ELSE 0 END AS nc, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 ELSE 0 END AS sc,
        o_orderkey % 1000 AS ic, CASE WHEN o_custkey % 2 = 0 OR o_orderkey % 6 <> 0 THEN o_orderkey % 300 END AS pt,
        CASE WHEN o_custkey % 5 = 0 OR (o_custkey % 5 = 1 AND o_orderkey % 2 = 0) THEN 'E' || (o_orderkey % 3) END AS err, o_orderkey % 7 < 3 OR NOT (o_custkey % 5 = 0 OR (o_custkey % 5 = 1 AND o_orderkey % 2 = 0)) AS indexed FROM orders),
      s AS (SELECT batch_id, count(*) AS commit_count, count(err) AS failed_commit_count, sum(CASE WHEN indexed THEN nc ELSE 0 END)::BIGINT AS new_chunk_count, sum(CASE WHEN indexed THEN sc ELSE 0 END)::BIGINT AS skipped_chunk_count,
        sum(CASE WHEN indexed THEN ic ELSE 0 END)::BIGINT AS embedding_input_chars,
        CASE WHEN count(*) FILTER (indexed AND pt IS NULL) = 0 THEN coalesce(sum(pt) FILTER (indexed), 0)::BIGINT END AS embedding_provider_tokens, arg_min(err, k) FILTER (err IS NOT NULL) AS error_type FROM c GROUP BY 1)
      SELECT *, CASE WHEN failed_commit_count = 0 THEN 'COMPLETED' WHEN failed_commit_count >= commit_count THEN 'FAILED' ELSE 'PARTIAL' END AS result FROM s""",
    "git_batch_records": """WITH c AS (SELECT o_custkey AS batch_id, o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 ELSE 0 END AS nc, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 ELSE 0 END AS sc,
        CASE WHEN o_custkey % 2 = 0 OR o_orderkey % 6 <> 0 THEN o_orderkey % 300 END AS pt, CASE WHEN o_custkey % 5 = 0 OR (o_custkey % 5 = 1 AND o_orderkey % 2 = 0) THEN 'E' || (o_orderkey % 3) END AS err FROM orders),
      f AS (SELECT *, err IS NULL OR k % 7 < 3 AS fine FROM c),
      s AS (SELECT batch_id, count(*) AS commit_count, count(err) AS failed, count(*) FILTER (fine AND k % 9 BETWEEN 1 AND 5) AS llm, count(*) FILTER (fine AND k % 9 = 0) AS capped,
        coalesce(sum(nc) FILTER (fine), 0)::BIGINT AS nc, coalesce(sum(sc) FILTER (fine), 0)::BIGINT AS sc, coalesce(sum(k % 1000) FILTER (fine), 0)::BIGINT AS ic, coalesce(sum(k % 40) FILTER (fine), 0)::DOUBLE AS ms,
        CASE WHEN count(*) FILTER (fine AND pt IS NULL) = 0 THEN coalesce(sum(pt) FILTER (fine), 0)::BIGINT END AS pt, arg_min(err, k) FILTER (err IS NOT NULL) AS err FROM f GROUP BY 1),
      w AS (SELECT *, batch_id % 11 = 0 AS whole FROM s)
      SELECT batch_id, 'ws' || (batch_id % 4) AS workspace_id, commit_count, CASE WHEN whole THEN commit_count ELSE failed END AS failed_commit_count,
        CASE WHEN NOT whole THEN nc END AS new_chunk_count, CASE WHEN NOT whole THEN sc END AS skipped_chunk_count, CASE WHEN NOT whole THEN ic END AS embedding_input_chars,
        CASE WHEN NOT whole THEN pt END AS embedding_provider_tokens, CASE WHEN NOT whole THEN ms END AS embed_ms, CASE WHEN whole THEN 0 ELSE llm END AS analysis_llm_count,
        CASE WHEN whole THEN 0 ELSE capped END AS analysis_capped_count, CASE WHEN whole THEN 'Broken' ELSE err END AS error_type,
        CASE WHEN whole OR failed >= commit_count THEN 'FAILED' WHEN failed = 0 THEN 'COMPLETED' ELSE 'PARTIAL' END AS result,
        CASE WHEN NOT whole THEN (batch_id % 60)::DOUBLE END AS analysis_ms, CASE WHEN NOT whole THEN batch_id % 3 + 1 END AS analysis_concurrency, (batch_id % 900)::DOUBLE AS total_ms FROM w""",
    "llm_budget_selection": """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 50 DESC, o_orderkey % 7 DESC, o_orderkey % 900 DESC, o_orderkey) <= 5 AS by_size,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5 AS by_order FROM orders""",
    "verify_daily_budget": """WITH r AS (SELECT event_id, ts::DATE AS d, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) <= 100 AS ok FROM events)
      SELECT strftime(d, '%Y-%m-%d') AS day, count(*) FILTER (ok) AS acquired, count(*) FILTER (NOT ok) AS limited, max(event_id) FILTER (ok) AS last_acquired FROM r GROUP BY 1""",
    "ingest_requests": f"""WITH {ASKED},
      again AS (SELECT * FROM docs WHERE analysis_status <> 'COMPLETED' AND id NOT IN (SELECT id FROM tasks WHERE request_id % 8 = 1))
      SELECT 'documents' AS part, concat_ws('|', analysis_status, workspace_id) AS what, count(*) AS n FROM docs GROUP BY 1, 2
      UNION ALL SELECT 'tasks', concat_ws('|', workspace_id, task_id, sens), count(*) FROM tasks GROUP BY 1, workspace_id, task_id, sens
      UNION ALL SELECT 'rejected', workspace_id, count(*) FROM asked WHERE source_id IS NULL GROUP BY 1, 2
      UNION ALL SELECT 'retry', doc_type, count(*) FROM again GROUP BY 1, 2
      UNION ALL SELECT 'snapshot', concat_ws('|', m.task_id, m.sens), count(*) FROM tasks t JOIN marks m USING (id) GROUP BY 1, m.task_id, m.sens""",
    "scan_text_files": "SELECT sum(octet_length(encode(html)) + 1)::BIGINT AS bytes, sum(length(html) + 1)::BIGINT AS chars FROM pages",
    "scan_events_jsonl": "SELECT event_type AS event, count(*) AS n, sum(event_id)::BIGINT AS ids, round(sum(value), 2) AS latency_ms FROM events GROUP BY 1",
    "scan_eval_records": """SELECT id, role, CASE WHEN id % 10 <> 4 THEN id % 50 END AS n, NULL::DOUBLE AS missing FROM (SELECT conv_id * 100 + turn AS id, role FROM conversations) WHERE id % 10 <> 3""",
    "scan_cases_strict": """SELECT 'case' AS kind, item_id::VARCHAR AS id, ['single_doc', 'cross_doc', 'distractor', 'acl_task', 'acl_restricted', 'out_of_corpus'][item_id % 6 + 1] AS label,
        CASE WHEN item_id % 4 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN item_id % 2 = 0 THEN 1 END AS m, item_id % 3 = 0 AS flag FROM benchmark
      UNION ALL SELECT 'pair', item_id::VARCHAR, CASE WHEN item_id % 2 = 0 THEN 'same_intent' ELSE 'different_intent' END, length(text), length(text), true FROM benchmark""",
    "scan_manifest": """SELECT 'doc-' || doc_id AS doc_key, 'Doc ' || source AS title, CASE WHEN doc_id % 3 = 0 THEN 'task-1' END AS task_id,
      CASE WHEN doc_id % 7 = 0 THEN 'restricted' ELSE 'normal' END AS sensitivity_level, lang AS topic, '' AS note FROM documents""",
    "training_export": f"""WITH c AS (SELECT conv_id, turn, arg_min(role, text) AS role, min(text) AS text FROM conversations GROUP BY 1, 2),
      p AS (SELECT a.conv_id, a.text AS q0, b.text AS a0, {_scrub_sql('a.text')} AS q, {_scrub_sql('b.text')} AS a FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
      t AS (SELECT *, {TOKEN_COUNT.format('q')} - {TOKEN_COUNT.format('q0')} + {TOKEN_COUNT.format('a')} - {TOKEN_COUNT.format('a0')} AS hits FROM p)
      SELECT 'ws' || (conv_id % 3) AS workspace_id, 'v1.' || (conv_id % 2) AS dataset_version, count(*) AS n, count(*) FILTER (conv_id % 2 = 0) AS faq, sum(length(q))::BIGINT AS q_chars, sum(length(a))::BIGINT AS a_chars,
        (SELECT count(*) FROM t WHERE conv_id % 3 = 1) AS again, (SELECT sum(hits)::BIGINT FROM t WHERE conv_id % 3 = 1) AS again_hits FROM t GROUP BY 1, 2""",
    "safe_names": r"""WITH p AS (SELECT unnest(string_split(url, '/')) AS name, generate_subscripts(string_split(url, '/'), 1) - 1 AS pos FROM pages)
      SELECT pos, CASE WHEN NOT regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9._-]{0,63}') THEN 'unsafe name' END AS problem, count(*) AS n FROM p GROUP BY 1, 2""",
}
