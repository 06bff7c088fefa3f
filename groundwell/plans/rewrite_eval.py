"""Quality of query rewrites per model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.functions.replies import answer_like, keyword_hit_rate, passthrough
from groundwell.operators.quantiles import percentiles


def model_metrics(records: DataFrame) -> DataFrame:
    """records: model, question, rewritten, error, expected_keywords, expect_passthrough,
    expected_doc, doc_hit, latency_ms, prompt_tokens, completion_tokens. Rates of nothing
    are NULL."""
    question, rewritten = F.col("question"), F.col("rewritten")
    ok = F.coalesce("error", F.lit("")) == ""
    scored = ok & rewritten.isNotNull()
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    rows = records.withColumn("ok", ok)
    rates = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(~F.col("ok")).alias("error_count"),
        F.avg(F.when(scored, flag(answer_like(question, rewritten)))).alias("answer_like_rate"),
        F.avg(F.when(scored, keyword_hit_rate(rewritten, F.col("expected_keywords")))).alias("keyword_hit_rate"),
        F.avg(
            F.when(scored & F.coalesce("expect_passthrough", F.lit(False)), flag(passthrough(question, rewritten)))
        ).alias("passthrough_accuracy"),
        F.avg(
            F.when(scored & F.col("expected_doc").isNotNull() & F.col("doc_hit").isNotNull(), flag(F.col("doc_hit")))
        ).alias("doc_hit_rate"),
        F.avg(F.when(F.col("ok"), F.col("prompt_tokens"))).alias("mean_prompt_tokens"),
        F.avg(F.when(F.col("ok"), F.col("completion_tokens"))).alias("mean_completion_tokens"),
    )
    lat = percentiles(
        rows.where("ok"), ["model"], F.col("latency_ms"), {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95}
    )
    return rates.join(lat, "model", "left")
