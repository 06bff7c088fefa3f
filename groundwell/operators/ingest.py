"""Ingest jobs: upserts, idempotent indexing, commit merge, embedding usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from groundwell.functions.text import replacement_ratio

# Texts per embedding call, estimated tokens per text, warning ratio of bad characters.
EMBED_BATCH, TOKENS_PER_TEXT, PARSE_WARN_RATIO = 100, 0.2, 0.05
# The stages of a document's ingest, in their order.
INGEST_STAGES = ("read", "chunk", "context", "embed", "store")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new rows, and all new rows."""
    touched = new.select(*keys).distinct()
    return old.join(touched, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last new row, else the old one. Repeats of a key are combined
    before they are shuffled."""
    columns = [c for c in new.columns if c not in (key, order)]
    last = new.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("row")).select(
        key, *(F.col(f"row.{c}").alias(c) for c in columns)
    )
    return old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def delete_by_key(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


def split_indexed(incoming: DataFrame, indexed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows still to index, rows skipped because their key is indexed)."""
    known = indexed.select(*keys).distinct()
    return incoming.join(known, keys, "left_anti"), incoming.join(known, keys, "left_semi")


def reuse_context(new: DataFrame, old: DataFrame) -> DataFrame:
    """Adds `context` from an old chunk of the same document with the same text, and `reused`.

    Both have doc_key, content; old also chunk_id and context. Copies within a document
    are reduced to their last context first, so that the join never multiplies rows.
    """
    memory = (
        old.where(F.coalesce("context", F.lit("")) != "")
        .groupBy("doc_key", F.sha1("content").alias("content_sha1"))
        .agg(F.max_by("context", "chunk_id").alias("context"))
    )
    return (
        new.withColumn("content_sha1", F.sha1("content"))
        .join(memory, ["doc_key", "content_sha1"], "left")
        .withColumn("reused", F.col("context").isNotNull())
    )


def _filled(col: Column) -> Column:
    return F.when(col != "", col)


def merge_commits(existing: DataFrame, incoming: DataFrame, users: DataFrame) -> DataFrame:
    """Commits by (workspace_id, commit_hash): known rows refreshed, others created.

    incoming also has `seq`, the order of arrival; the same commit may arrive repeatedly.
    Source, short hash and branch are only filled where empty; author name, email and
    message are replaced by later non-empty values, the push time by any later value. A
    created row looks its author up by the email of its first arrival.
    """
    keys = ["workspace_id", "commit_hash"]

    def earliest(c: str) -> Column:
        v = _filled(F.col(c))
        return F.min_by(v, F.when(v.isNotNull(), F.col("seq")))

    def latest(c: str) -> Column:
        v = _filled(F.col(c))
        return F.max_by(v, F.when(v.isNotNull(), F.col("seq")))

    # Column names may have been used in `existing` too, hence the prefix.
    batch = incoming.groupBy(*keys).agg(
        *(earliest(c).alias(f"in_{c}") for c in ("source_id", "short_hash", "branch_name")),
        *(latest(c).alias(f"in_{c}") for c in ("author_name", "author_email", "commit_message")),
        F.max_by("pushed_at", F.when(F.col("pushed_at").isNotNull(), F.col("seq"))).alias("in_pushed_at"),
        F.min_by("author_email", "seq").alias("first_email"),
        F.min("seq").alias("first_seq"),
    )
    directory = users.groupBy("email").agg(F.min("user_id").alias("user_id"))
    known = existing.withColumn("_known", F.lit(True))
    joined = known.join(batch, keys, "full").join(
        directory, F.col("first_email") == F.col("email"), "left"
    )
    old = F.col("_known").isNotNull()

    def fill(c: str) -> Column:
        return F.coalesce(_filled(F.col(c)), F.col(f"in_{c}"), F.col(c)).alias(c)

    def renew(c: str) -> Column:
        return F.coalesce(F.col(f"in_{c}"), F.col(c)).alias(c)

    return joined.select(
        *keys,
        fill("source_id"),
        fill("short_hash"),
        fill("branch_name"),
        F.when(old, F.col("author_id")).otherwise(F.col("user_id")).alias("author_id"),
        F.coalesce(F.col("in_author_name"), F.col("author_name"), F.lit("unknown")).alias("author_name"),
        renew("author_email"),
        renew("commit_message"),
        renew("pushed_at"),
        (~old).alias("created"),
    )


def upsert_analysis(existing: DataFrame, analysed: DataFrame, at: Column) -> DataFrame:
    """One analysis per commit_id; a new one replaces the fields of the old one."""
    done = analysed.withColumn("index_status", F.lit("COMPLETED")).withColumn("analyzed_at", at)
    return replace_by_key(existing, done, ["commit_id"])


def all_or_null(col: Column) -> Column:
    """A sum that is NULL when any part is missing."""
    return F.when(F.count(col) == F.count(F.lit(1)), F.sum(col))


def with_metadata(chunks: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """Adds `metadata`: position, text fingerprint and the extra fields of the source, which
    win over equal names. Fields without a value are kept as such."""
    base = {
        "chunk_index": F.col("chunk_index"), "char_start": F.col("char_start"), "char_end": F.col("char_end"),
        "content_sha1": F.sha1("content"),
    }
    entries = [c for k, v in {**base, **extra}.items() for c in (F.lit(k), v.cast("string"))]
    return chunks.withColumn("metadata", F.create_map(*entries))


def embedding_usage(chunks: DataFrame, provider_tokens: Column, doc: str = "doc_id", counters: dict[str, Column] | None = None) -> DataFrame:
    """Per document: chunks, calls, input characters, estimated and reported tokens, and sums of
    `counters` over its chunks.

    The texts of a document are sent in calls of EMBED_BATCH; `provider_tokens` is an
    aggregate over the texts of one call. A document with a call that reported nothing
    has no reported total.
    """
    call = F.floor(F.col("chunk_index") / EMBED_BATCH).alias("call")
    counters = counters or {}
    calls = chunks.groupBy(doc, call).agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.length("input")).alias("chars"), provider_tokens.alias("reported"),
        *(F.sum(c).alias(name) for name, c in counters.items()),
    )
    return calls.groupBy(doc).agg(
        F.sum("texts").alias("chunk_count"),
        F.count(F.lit(1)).alias("calls"),
        F.sum("chars").alias("embedding_input_chars"),
        F.round(F.sum("texts") * TOKENS_PER_TEXT, 1).alias("estimated_tokens"),
        all_or_null(F.col("reported")).alias("provider_tokens"),
        *(F.sum(name).alias(name) for name in counters),
    )


def stage_times(timings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: `<stage>_ms` of every stage, null where it was not entered, and `total_ms`.

    timings: document, stage, ms; a stage entered twice adds up. Other stages count in the total only.
    """
    return timings.groupBy(doc).agg(
        *(F.sum(F.when(F.col("stage") == s, F.col("ms"))).alias(f"{s}_ms") for s in INGEST_STAGES),
        F.sum("ms").alias("total_ms"),
    )


def document_records(documents: DataFrame, chunks: DataFrame, timings: DataFrame, provider_tokens: Column, limit: float = PARSE_WARN_RATIO) -> DataFrame:
    """One record per ingested document: sizes, chunks, embedding input and tokens, context counters, stage
    times, result, failed stage and error.

    documents: doc_id, workspace_id, doc_type, file_bytes, text, failure_stage (one of INGEST_STAGES or null),
    error_type. chunks: doc_id, chunk_index, input, context, context_calls (0 if none was made),
    context_reused. timings: as for `stage_times`. provider_tokens: as for `embedding_usage`.

    A record holds what was known when the document failed: no text after a failed reading, no chunks
    after failed chunking, context counters once contexts are made, input sizes once texts were to be
    embedded, tokens once they were. The text is measured before anything is joined.
    """
    called, given = F.coalesce(F.col("context_calls"), F.lit(0)), F.coalesce(F.col("context"), F.lit("")) != ""
    reused = F.coalesce(F.col("context_reused"), F.lit(False))
    usage = embedding_usage(chunks, provider_tokens, "doc_id", {
        "context_llm_calls": called,
        "context_failed": F.when(~reused & (called > 0) & ~given, 1).otherwise(0),
        "context_reused": F.when(reused, 1).otherwise(0),
        "context_retried": F.greatest(called - 1, F.lit(0)),
    }).drop("calls", "estimated_tokens")
    # How many stages were passed; all of them without a failure.
    passed = F.coalesce(*(F.when(F.col("failure_stage") == s, i) for i, s in enumerate(INGEST_STAGES)), F.lit(len(INGEST_STAGES)))
    after = {s: passed > i for i, s in enumerate(INGEST_STAGES)}
    measured = documents.select(
        "doc_id", "workspace_id", "doc_type", "file_bytes", "failure_stage", "error_type", passed.alias("passed"),
        F.when(after["read"], F.length("text")).otherwise(0).alias("char_count"),
        F.when(after["read"], replacement_ratio(F.col("text"))).alias("replacement_ratio"),
    )
    joined = measured.join(usage, "doc_id", "left").join(stage_times(timings), "doc_id", "left")
    reached = {s: F.col("passed") > i for i, s in enumerate(INGEST_STAGES)}
    none = F.lit(0)
    count = F.when(reached["chunk"], F.coalesce("chunk_count", none)).otherwise(none)
    return joined.select(
        "doc_id", "workspace_id", "doc_type", "file_bytes", "char_count", count.alias("chunk_count"), "replacement_ratio",
        # The embedding stage was entered when contexts were done.
        F.when(reached["context"], F.col("embedding_input_chars")).alias("embedding_input_chars"),
        F.when(reached["embed"], F.col("provider_tokens")).alias("embedding_provider_tokens"),
        *(
            F.when(reached["context"], F.coalesce(c, none)).otherwise(none).alias(c)
            for c in ("context_llm_calls", "context_failed", "context_reused", "context_retried")
        ),
        *(f"{s}_ms" for s in INGEST_STAGES), "total_ms",
        ingest_result(count, F.col("replacement_ratio"), F.col("failure_stage"), limit).alias("result"),
        "failure_stage", "error_type",
    )


def observed_records(records: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """Records that count themselves while they are written, and the counts: documents, failed, empty, chunks,
    embedding_input_chars and total_ms of the run, in `Observation.get` after the first action."""
    seen = Observation(name)
    return records.observe(
        seen, F.count(F.lit(1)).alias("documents"), F.count_if(F.col("result") == "FAILED").alias("failed"),
        F.count_if(F.col("result") == "EMPTY").alias("empty"), F.sum("chunk_count").alias("chunks"),
        F.sum("embedding_input_chars").alias("embedding_input_chars"), F.sum("total_ms").alias("total_ms"),
    ), seen


def ingest_result(chunk_count: Column, ratio: Column, failure_stage: Column, limit: float = PARSE_WARN_RATIO) -> Column:
    return (
        F.when(failure_stage.isNotNull(), "FAILED")
        .when(F.coalesce(chunk_count, F.lit(0)) == 0, "EMPTY")
        .when(ratio > limit, "PARSE_WARN")
        .otherwise("COMPLETED")
    )


def batch_result(failed: Column, total: Column) -> Column:
    return F.when(failed == 0, "COMPLETED").when(failed >= total, "FAILED").otherwise("PARTIAL")


def git_batch_summary(commits: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """Per batch_id: commits, failures, new and skipped chunks, token total, embedding time, analyses asked of a
    model and those kept from it by the cap, result, first error.

    commits: batch_id, position, new_chunks, skipped_chunks, input_chars, provider_tokens, embed_ms,
    error_type, failed_stage (`index` or `analysis`), analysis (`llm`, `capped`, or null). A commit whose
    indexing failed counts no chunks, no time and no analysis; one that failed later was indexed before and
    its analysis was tried. Skipped commits report 0 tokens. `embed_ms` and `analysis` may be left out.

    batches: batch_id, workspace_id, analysis_ms, analysis_concurrency, total_ms, error_type. Its columns
    come along. A batch with an error of its own failed as a whole: all its commits count as failed, and
    nothing that was rolled back is counted.
    """
    for name, kind in (("embed_ms", "double"), ("analysis", "string")):
        if name not in commits.columns:
            commits = commits.withColumn(name, F.lit(None).cast(kind))
    failed = F.col("error_type").isNotNull()
    fine = ~failed | F.coalesce(F.col("failed_stage") == "analysis", F.lit(False))
    per = commits.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.count_if(failed).alias("failed_commit_count"),
        F.sum(F.when(fine, F.col("new_chunks")).otherwise(0)).alias("new_chunk_count"),
        F.sum(F.when(fine, F.col("skipped_chunks")).otherwise(0)).alias("skipped_chunk_count"),
        F.sum(F.when(fine, F.col("input_chars")).otherwise(0)).alias("embedding_input_chars"),
        F.when(
            F.count_if(fine & F.col("provider_tokens").isNull()) == 0,
            F.coalesce(F.sum(F.when(fine, F.col("provider_tokens"))), F.lit(0)),
        ).alias("embedding_provider_tokens"),
        F.sum(F.when(fine, F.col("embed_ms")).otherwise(0)).alias("embed_ms"),
        F.count_if(fine & (F.col("analysis") == "llm")).alias("analysis_llm_count"),
        F.count_if(fine & (F.col("analysis") == "capped")).alias("analysis_capped_count"),
        F.min_by("error_type", F.when(failed, F.col("position"))).alias("error_type"),
    ).withColumn("result", batch_result(F.col("failed_commit_count"), F.col("commit_count")))
    if batches is None:
        return per
    whole = F.col("batch_error").isNotNull()
    undone = {c: F.when(~whole, F.col(c)).alias(c) for c in (
        "new_chunk_count", "skipped_chunk_count", "embedding_input_chars", "embedding_provider_tokens", "embed_ms",
        "analysis_ms", "analysis_concurrency",
    )}
    instead = {
        "failed_commit_count": F.when(whole, F.col("commit_count")).otherwise(F.col("failed_commit_count")),
        "analysis_llm_count": F.when(whole, F.lit(0)).otherwise(F.col("analysis_llm_count")),
        "analysis_capped_count": F.when(whole, F.lit(0)).otherwise(F.col("analysis_capped_count")),
        "error_type": F.coalesce("batch_error", "error_type"),
        "result": F.when(whole, "FAILED").otherwise(F.col("result")),
    }
    known = per.join(batches.withColumnRenamed("error_type", "batch_error"), "batch_id", "left")
    return known.select(*(undone.get(c) if c in undone else instead[c].alias(c) if c in instead else F.col(c) for c in known.columns if c != "batch_error"))


def register_documents(known: DataFrame, requests: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(document table, ingest tasks). A request names a document or gets a new id; named
    documents that exist are kept as they are, others start as PENDING.

    requests: request_id, workspace_id, source_id, data_source_id, document_id, task_id,
    title, doc_type, file_path, sensitivity_level. The new id is derived from the request,
    so that a repeated run registers the same document.
    """
    fresh = F.sha1(F.col("request_id").cast("string"))
    asked = requests.withColumn("id", F.coalesce(_filled(F.col("document_id")), fresh)).withColumn(
        "source_id", F.coalesce(_filled(F.col("source_id")), _filled(F.col("data_source_id")))
    )
    columns = ["workspace_id", "source_id", "task_id", "title", "doc_type", "file_path"]
    new = (
        asked.groupBy("id")
        .agg(F.min_by(F.struct(*columns), "request_id").alias("r"))
        .select("id", *(F.col(f"r.{c}").alias(c) for c in columns))
        .withColumn("analysis_status", F.lit("PENDING"))
        .withColumn("created_at", at)
        .join(known.select("id"), "id", "left_anti")
    )
    table = known.unionByName(new, allowMissingColumns=True)
    tasks = asked.join(table.select("id", F.col("task_id").alias("doc_task")), "id").select(
        "request_id", F.col("id").alias("document_id"), "workspace_id", "file_path", "doc_type",
        F.coalesce(_filled(F.col("task_id")), F.col("doc_task")).alias("task_id"),
        F.coalesce("sensitivity_level", F.lit("normal")).alias("sensitivity_level"),
    )
    return table, tasks


def split_without_source(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commit ingests need a source: (accepted with source_id resolved, rejected)."""
    resolved = requests.withColumn(
        "source_id", F.coalesce(_filled(F.col("source_id")), _filled(F.col("data_source_id")))
    )
    return resolved.where(F.col("source_id").isNotNull()), resolved.where(F.col("source_id").isNull())


def retryable(documents: DataFrame, running: DataFrame) -> DataFrame:
    """Documents that may be ingested again: not completed, not running now."""
    return (
        documents.where(F.col("analysis_status") != "COMPLETED")
        .join(running.select("id").distinct(), "id", "left_anti")
        .withColumn("doc_type", F.coalesce(_filled(F.col("doc_type")), F.lit("general")))
    )


def with_access_defaults(chunks: DataFrame) -> DataFrame:
    """Chunks from before access control: no task, normal sensitivity."""
    for name, value in (("task_id", F.lit(None).cast("string")), ("sensitivity_level", F.lit("normal"))):
        current = F.col(name) if name in chunks.columns else F.lit(None).cast("string")
        chunks = chunks.withColumn(name, F.coalesce(current, value))
    return chunks


def snapshot_access(chunks: DataFrame, tasks: DataFrame) -> DataFrame:
    """Copies task and sensitivity of the ingest task onto each chunk; only documents carry a task."""
    marks = tasks.select("source_type", "source_id", F.col("task_id").alias("_task"), F.col("sensitivity_level").alias("_sens"))
    return chunks.join(marks, ["source_type", "source_id"], "left").select(
        *(c for c in chunks.columns if c not in ("task_id", "sensitivity_level")),
        F.when(F.col("source_type") == "document", F.col("_task")).alias("task_id"),
        F.when(F.col("source_type") == "owner_answer", "normal")
        .otherwise(F.coalesce("_sens", F.lit("normal")))
        .alias("sensitivity_level"),
    )


def embed(chunks: DataFrame, function, dimension_column: str = "vector", batch: int = EMBED_BATCH) -> DataFrame:
    """Adds vectors from a user function `list[str] -> list[list[float]]`, called per batch."""

    def run(frames):
        for frame in frames:
            texts = frame["input"].tolist()
            vectors = []
            for i in range(0, len(texts), batch):
                vectors.extend(function(texts[i : i + batch]))
            frame[dimension_column] = vectors
            yield frame

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(run, f"{fields}, {dimension_column} array<double>")
