"""Reports over event records. Percentiles and averages of nothing are 0.0 here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.operators.quantiles import percentiles
from groundwell.session import materialize

P50_P95 = {"p50": 0.5, "p95": 0.95}


def _or_zero(*names: str) -> list[Column]:
    return [F.coalesce(n, F.lit(0.0)).alias(n) for n in names]


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be NULL, keeping the left copy of the keys."""
    other = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, on, how).drop(*(f"_{k}" for k in keys))


def daily_usage(usage: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Tokens per workspace, day and model, added to what the table already has."""
    rows = usage.select("workspace_id", F.to_date("ts").alias("date"), "embedding_model", "embedding_tokens")
    if existing is not None:
        rows = rows.unionByName(existing.select(*rows.columns))
    return rows.groupBy("workspace_id", "date", "embedding_model").agg(
        F.sum(F.col("embedding_tokens").cast("decimal(12,1)")).cast("decimal(22,1)").alias("embedding_tokens")
    )


def usage_summary(usage: DataFrame, workspace: str) -> DataFrame:
    return usage.where(F.col("workspace_id") == workspace).orderBy("date", "embedding_model")


def result_summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: records with a result, and the share that did not fail. Groups without
    results do not appear."""
    return records.where(F.col("result").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("result") == "FAILED").alias("failed"),
        F.avg(F.when(F.col("result") != "FAILED", 100.0).otherwise(0.0)).alias("success_rate"),
    )


def result_counts(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.where(F.col("result").isNotNull()).groupBy(*keys, "result").agg(F.count(F.lit(1)).alias("n"))


def failure_distribution(records: DataFrame) -> DataFrame:
    """(dimension, value, n) of failed records by stage and by error type."""
    known = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("unknown"))
    failed = records.where(F.col("result") == "FAILED").select(
        known("failure_stage").alias("failure_stage"), known("error_type").alias("error_type")
    )
    sets = failed.groupingSets([["failure_stage"], ["error_type"]], "failure_stage", "error_type").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("failure_stage").alias("by_error")
    )
    return sets.select(
        F.when(F.col("by_error") == 1, "error_type").otherwise("failure_stage").alias("dimension"),
        F.coalesce("failure_stage", "error_type").alias("value"),
        "n",
    )


def stage_values(records: DataFrame, record: str = "record") -> DataFrame:
    """(event, stage, value) of every numeric `*_ms` key of VARIANT records."""
    pairs = records.select("event", "record").lateralJoin(
        records.sparkSession.tvf.variant_explode(F.col("record").outer())
    )
    kind = F.schema_of_variant("value")
    return pairs.where(F.col("key").endswith("_ms") & kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")).select(
        "event", F.col("key").alias("stage"), F.try_variant_get("value", "$", "double").alias("value")
    )


def stage_percentiles(values: DataFrame) -> DataFrame:
    """p50 and p95 per event and stage. The values are written first, as parsing the records
    costs more than reading the values twice."""
    return percentiles(materialize(values), ["event", "stage"], F.col("value"), P50_P95)


def call_breakdown(calls: DataFrame) -> DataFrame:
    """Per purpose and model: calls, latency percentiles, mean tokens, unreadable share, errors."""
    known = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("unknown")).alias(c)
    rows = calls.select(
        known("purpose"), known("model"), "latency_ms", "prompt_tokens", "completion_tokens", "parse_ok", "error_type"
    )
    keys = ["purpose", "model"]
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.avg("prompt_tokens"), F.lit(0.0)).alias("avg_prompt_tokens"),
        F.coalesce(F.avg("completion_tokens"), F.lit(0.0)).alias("avg_completion_tokens"),
        F.coalesce(F.avg(F.when(F.col("parse_ok"), 0.0).when(~F.col("parse_ok"), 100.0)), F.lit(0.0)).alias(
            "parse_failure_rate"
        ),
        F.count_if(F.coalesce("error_type", F.lit("")) != "").alias("error_count"),
    )
    lat = percentiles(rows, keys, F.col("latency_ms"), {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95})
    return totals.join(lat, keys, "left").select(
        *totals.columns, *_or_zero("p50_latency_ms", "p95_latency_ms")
    )


def token_sums(calls: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return calls.groupBy("purpose", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.coalesce("prompt_tokens", zero)).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", zero)).alias("completion_tokens"),
    )


def cache_summary(chats: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of requests with the cache on: hits, verification, latency percentiles.

    Percentiles of no value are NULL. `limit` marks a verification that the daily budget
    left out: no call, counted apart.
    """
    on = chats.where(F.coalesce("cache_enabled", F.lit(False))).withColumn(
        "hit", F.coalesce("cache_hit", F.lit(False))
    )
    res = F.col("cache_verify_result")
    asked = res.isNotNull() & (res != "limit")
    outcomes = {o: F.count_if(res == o).alias(f"verify_{o}") for o in ("yes", "no", "invalid", "error", "timeout")}
    totals = on.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("enabled_count"),
        F.count_if("hit").alias("hit_count"),
        F.avg(F.when(F.col("hit"), 100.0).otherwise(0.0)).alias("hit_rate"),
        F.count_if(asked).alias("verify_count"),
        *outcomes.values(),
        F.count_if(res == "limit").alias("verify_limited_count"),
        F.count_if(F.col("hit") & (res == "yes")).alias("verify_hit_count"),
        F.coalesce(
            F.avg(F.when(F.col("hit"), F.when(res == "yes", 100.0).otherwise(0.0))), F.lit(0.0)
        ).alias("verify_hit_share"),
    )
    # All latencies in long form, so that one percentile job serves them.
    series = F.array(
        F.struct(F.when(F.col("hit"), "hit_total").otherwise("miss_total").alias("s"), F.col("total_ms").alias("v")),
        F.struct(F.when(F.col("hit"), "hit_ttft").otherwise("miss_ttft").alias("s"), F.col("ttft_ms").alias("v")),
        F.struct(F.when(asked, "verify").alias("s"), F.col("cache_verify_ms").alias("v")),
    )
    long = on.select(*keys, F.inline(series)).where(F.col("s").isNotNull())
    names = ("hit_total", "hit_ttft", "miss_total", "miss_ttft", "verify")
    ranks = percentiles(long, [*keys, "s"], F.col("v"), P50_P95)
    wide = ranks.groupBy(*keys).agg(
        *(F.max(F.when(F.col("s") == n, F.col(p))).alias(f"{n}_{p}") for n in names for p in P50_P95)
    )
    return _null_safe(totals, wide, keys)


def cost_buckets(calls: DataFrame) -> DataFrame:
    """Per size bucket and for all: calls, calls without error, mean, p50 and p95 of tokens
    and latency over the latter, rounded to one digit."""
    both = calls.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.lit("all"))))
    ok = F.coalesce("error_type", F.lit("")) == ""
    counts = both.groupBy("bucket").agg(F.count(F.lit(1)).alias("calls"), F.count_if(ok).alias("ok_calls"))
    long = both.where(ok).select(
        "bucket",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v"))
                    for n in ("prompt_tokens", "completion_tokens", "latency_ms")
                )
            )
        ).alias("m"),
    ).select("bucket", "m.metric", "m.v").where(F.col("v").isNotNull())
    means = long.groupBy("bucket", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    ranks = percentiles(long, ["bucket", "metric"], F.col("v"), P50_P95)
    dist = means.join(ranks, ["bucket", "metric"])
    return counts.join(dist, "bucket", "left").select(
        "bucket", "calls", "ok_calls", "metric", "n", *(F.round(c, 1).alias(c) for c in ("mean", "p50", "p95"))
    )


def cache_benefit(pairs: DataFrame, target_ms: float = 2000.0) -> DataFrame:
    """One row on what the cache saves, from pairs of a first (miss) and a repeated request.

    pairs: miss_ms, hit_ms, miss_tokens, hit_tokens, cache_hit, verify_result, verify_tokens.
    """
    yes = F.col("cache_hit") & (F.col("verify_result") == "yes")
    totals = pairs.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if("cache_hit").alias("hit_count"),
        F.count_if(yes).alias("verified_hit_count"),
        F.avg("miss_tokens").alias("mean_tokens_miss"),
        F.avg("hit_tokens").alias("mean_tokens_hit"),
        F.avg(F.when(yes, F.col("hit_ms"))).alias("mean_verified_hit_ms"),
        F.avg("verify_tokens").alias("mean_verify_tokens"),
    )
    long = pairs.select(
        F.inline(
            F.array(
                F.struct(F.lit("miss").alias("s"), F.col("miss_ms").alias("v")),
                F.struct(F.when(F.col("cache_hit"), "hit").alias("s"), F.col("hit_ms").alias("v")),
            )
        )
    ).where("s IS NOT NULL")
    ranks = percentiles(long, ["s"], F.col("v"), P50_P95).agg(
        *(F.max(F.when(F.col("s") == n, F.col(p))).alias(f"{n}_{p}") for n in ("miss", "hit") for p in P50_P95)
    )
    # Two rows with different columns, put into one.
    both = totals.unionByName(ranks, allowMissingColumns=True)
    row = both.agg(*(F.max(c).alias(c) for c in both.columns))
    return row.withColumns(
        {
            "token_saving_rate": (F.col("mean_tokens_miss") - F.col("mean_tokens_hit"))
            / F.nullif("mean_tokens_miss", F.lit(0.0)),
            "speedup_p50": F.col("miss_p50") / F.nullif("hit_p50", F.lit(0.0)),
            "meets_target": F.coalesce(F.col("hit_p50") <= target_ms, F.lit(False)),
        }
    )
