"""One record per answered request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import short_digest
from groundwell.operators.access import unrestricted
from groundwell.operators.cache import storable

# Stage times a record carries.
STAGES = (
    "rewrite_ms", "retrieve_ms", "embed_ms", "bm25_ms", "vector_ms", "acl_filter_ms", "rerank_ms", "grounding_ms",
    "llm_ms", "ttft_ms", "total_ms",
)


def token_usage(main: Column, rewrite: Column, judge: Column, answered: Column, judged: Column) -> Column:
    """Usage of one request: zeros for the main model where it was not called, NULL for
    steps that did not run."""
    zero = F.lit(0).cast("long")
    return F.struct(
        F.struct(
            main["model"].alias("model"),
            F.when(answered, main["prompt_tokens"]).otherwise(zero).alias("prompt_tokens"),
            F.when(answered, main["completion_tokens"]).otherwise(zero).alias("completion_tokens"),
        ).alias("main"),
        rewrite.alias("rewrite"),
        F.when(judged, judge).alias("grounding"),
    )


# Fixed names: what the cache and the reranker report about a request, with their types.
OPTIONAL = {
    "acl_refetch_count": "long",
    "cache_similarity": "double",
    "cache_lookup_ms": "double",
    "cache_verify_ms": "double",
    "cache_verify_result": "string",
    "rerank_stage": "string",
    "rerank_prompt_tokens": "long",
    "rerank_completion_tokens": "long",
    "rerank_candidates": "long",
}


def request_records(requests: DataFrame, calls: DataFrame, hits: DataFrame, assessed: DataFrame) -> DataFrame:
    """Records for the usage reports: times, quality and tokens, no text and no user.

    calls: query_id, session_id, role, history_len, cache_enabled, cache_hit,
    cache_confidence, rewrite, grounding, main (usage structs), answer, context_truncated,
    stages MAP, and any of the columns in OPTIONAL; those it lacks are NULL. A cache hit is groundable with the confidence it was stored with.
    """
    found = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.max("vector_score").alias("top_similarity")
    )
    who = requests.select("query_id", "workspace_id", "accessible_task_ids", "can_view_restricted")
    rows = (
        who.join(calls, "query_id")
        .join(assessed.withColumnRenamed("stage", "assess_stage"), "query_id")
        .join(found, "query_id", "left")
    )
    hit, reason = F.col("cache_hit"), F.col("fallback_reason")
    groundable = hit | F.col("is_groundable")
    judged = ~hit & (F.col("assess_stage") != "threshold") & (F.coalesce(reason, F.lit("")) != "llm_error")
    usage = token_usage(F.col("main"), F.col("rewrite"), F.col("grounding"), ~hit & F.col("is_groundable"), judged)
    rows = rows.withColumn("usage", usage)
    tokens = [
        F.col(f"usage.{step}.{field}").alias(f"{step}_{field}")
        for step in ("main", "rewrite", "grounding")
        for field in ("model", "prompt_tokens", "completion_tokens")
    ]
    return rows.select(
        "query_id",
        short_digest(F.col("session_id")).alias("session_id_hash"),
        "workspace_id",
        "role",
        (F.floor(F.col("history_len") / 2) + 1).cast("long").alias("turn"),
        *(F.get(F.array(F.col("stages")[s]), F.lit(0)).alias(s) for s in STAGES),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.coalesce("top_similarity", F.lit(0.0)).alias("top_similarity"),
        groundable.alias("is_groundable"),
        F.when(hit, F.col("cache_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, "cache").otherwise(F.col("assess_stage")).alias("grounding_stage"),
        F.when(~hit, reason).alias("grounding_fallback_reason"),
        (~unrestricted(F.col("accessible_task_ids"), F.col("can_view_restricted"))).alias("access_filtered"),
        *tokens,
        "context_truncated",
        "cache_enabled",
        "cache_hit",
        *(F.col(c).cast(kind).alias(c) if c in calls.columns else F.lit(None).cast(kind).alias(c) for c, kind in OPTIONAL.items()),
        (
            F.col("cache_enabled")
            & storable(hit, F.col("history_len") == 0, F.col("is_groundable"), reason, F.col("answer"))
        ).alias("storable"),
    )
