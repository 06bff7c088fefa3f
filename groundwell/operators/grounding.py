"""Whether a request can be answered from what was retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: default similarity below which no judge is asked.
THRESHOLD = 0.35


def assess(requests: DataFrame, hits: DataFrame, judgments: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, is_groundable, confidence, stage, fallback_reason, suggested_owner_id.

    hits: query_id, rank, source_type, author_id, vector_score. judgments: query_id,
    is_groundable, confidence, error; an absent row or an error counts as a failed call,
    a NULL field as an unreadable reply. Both let the request pass. The owner is the
    author of the most similar commit, named only when the request does not pass.
    """
    owner = F.col("author_id").isNotNull() & (F.col("author_id") != "") & (F.col("source_type") == "git_commit")
    best = hits.groupBy("query_id").agg(
        F.max("vector_score").alias("best"),
        F.max_by(
            F.when(owner, F.col("author_id")),
            F.when(owner, F.struct(F.col("vector_score").alias("s"), (-F.col("rank")).alias("r"))),
        ).alias("owner"),
    )
    judged = (
        requests.select("query_id")
        .join(best, "query_id", "left")
        .join(judgments.withColumn("called", F.lit(True)), "query_id", "left")
    )
    failed = F.col("called").isNull() | F.col("error").isNotNull()
    unread = F.col("is_groundable").isNull() | F.col("confidence").isNull()
    below = F.col("best").isNull() | (F.col("best") < threshold)
    reason = F.when(below, None).when(failed, "llm_error").when(unread, "parse_error")
    staged = judged.withColumn("fallback_reason", reason).withColumn(
        "passes",
        F.when(below, False).when(F.col("fallback_reason").isNotNull(), True).otherwise(F.col("is_groundable")),
    )
    return staged.select(
        "query_id",
        F.col("passes").alias("is_groundable"),
        F.when(below, 0.0)
        .when(F.col("fallback_reason").isNotNull(), F.col("best"))
        .otherwise(F.col("confidence"))
        .alias("confidence"),
        F.when(F.col("fallback_reason").isNotNull(), "llm_fallback")
        .when(below, "threshold")
        .otherwise("llm")
        .alias("stage"),
        "fallback_reason",
        F.when(~F.col("passes"), F.col("owner")).alias("suggested_owner_id"),
    )


def effective(judged: str = "llm_is_groundable", reason: str = "fallback_reason"):
    """The judge's verdict with failed calls passing."""
    return F.col(reason).isNotNull() | F.coalesce(F.col(judged), F.lit(False))


def final_decision(threshold, similarity: str = "top_similarity"):
    """The similarity gate, then the verdict."""
    return (F.coalesce(F.col(similarity), F.lit(0.0)) >= threshold) & effective()

