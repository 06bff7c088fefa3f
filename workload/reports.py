"""Usage and latency reports over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.plans import metrics
from groundwell.session import scratch_dir
from groundwell.sources import files, jsonl
from workload import bindings as b
from workload.evaluation import rounded


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as records of model calls and chat requests."""
    i, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("long")
    failed = F.col("event_type") == "error"
    return b.table(spark, sf, "events").select(
        i.alias("id"),
        "ts",
        F.concat(F.lit("ws"), u % 4).alias("workspace_id"),
        F.when(i % 17 != 0, F.col("event_type")).alias("purpose"),
        F.concat(F.lit("m"), u % 3).alias("model"),
        F.when(i % 13 != 0, F.col("value")).alias("latency_ms"),
        F.when(i % 5 != 0, k).alias("prompt_tokens"),
        (k % 20).alias("completion_tokens"),
        F.when(i % 3 != 0, i % 11 != 0).alias("parse_ok"),
        F.when(i % 31 != 0, F.when(failed, "FAILED").when(i % 7 == 0, "PARTIAL").otherwise("COMPLETED")).alias("result"),
        F.when(failed & (i % 2 == 0), F.concat(F.lit("stage-"), i % 4)).alias("failure_stage"),
        F.when(failed, F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("Error"), u % 3))).alias("error_type"),
        (i % 2 == 0).alias("cache_enabled"),
        (i % 4 == 0).alias("cache_hit"),
        F.when(i % 6 == 0, "yes").when(i % 10 == 2, "no").when(i % 14 == 4, "limit").alias("cache_verify_result"),
        F.when(i % 6 == 0, F.col("value") / 2).alias("cache_verify_ms"),
        (F.col("value") * 10).alias("total_ms"),
        F.when(i % 9 != 0, F.col("value") * 3).alias("ttft_ms"),
        (k * 0.2).alias("embedding_tokens"),
    )


CALLS = """calls AS (
  SELECT event_id AS id, ts, 'ws' || (user_id % 4) AS workspace_id, CASE WHEN event_id % 17 <> 0 THEN event_type END AS purpose,
    'm' || (user_id % 3) AS model, CASE WHEN event_id % 13 <> 0 THEN value END AS latency_ms,
    CASE WHEN event_id % 5 <> 0 THEN (props->>'$.k')::BIGINT END AS prompt_tokens, (props->>'$.k')::BIGINT % 20 AS completion_tokens,
    CASE WHEN event_id % 3 <> 0 THEN event_id % 11 <> 0 END AS parse_ok,
    CASE WHEN event_id % 31 <> 0 THEN CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_id % 7 = 0 THEN 'PARTIAL' ELSE 'COMPLETED' END END AS result,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'stage-' || (event_id % 4) END AS failure_stage,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Error' || (user_id % 3) END END AS error_type,
    event_id % 2 = 0 AS cache_enabled, event_id % 4 = 0 AS cache_hit,
    CASE WHEN event_id % 6 = 0 THEN 'yes' WHEN event_id % 10 = 2 THEN 'no' WHEN event_id % 14 = 4 THEN 'limit' END AS cache_verify_result,
    CASE WHEN event_id % 6 = 0 THEN value / 2 END AS cache_verify_ms, value * 10 AS total_ms, CASE WHEN event_id % 9 <> 0 THEN value * 3 END AS ttft_ms,
    (props->>'$.k')::BIGINT * 0.2::DOUBLE AS embedding_tokens FROM events)"""


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of the events as the stored table, the second half added to it."""
    rows = calls(spark, sf).withColumnRenamed("model", "embedding_model")
    early = F.col("ts") < "2024-01-15 12:00:00"
    stored = metrics.daily_usage(rows.where(early))
    return metrics.daily_usage(rows.where(~early), stored)


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd")).withColumn(
        "embedding_tokens", F.col("embedding_tokens").cast("double")
    )


def usage_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_usage(spark, sf))


def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Written by workspace and read back for one of them."""
    path = scratch_dir(spark, "usage")
    files.write_workspaces(_usage(spark, sf), path)
    back = files.scan_workspace(spark, path, "ws1", ["workspace_id", "date", "embedding_model", "embedding_tokens"])
    return _plain(metrics.usage_summary(back, "ws1"))


def stage_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Call records as JSON lines, whose `_ms` keys are found at read time."""
    path = scratch_dir(spark, "metrics")
    rows = calls(spark, sf).select(
        F.coalesce("purpose", F.lit("other")).alias("event"), "id", "latency_ms", "total_ms", "ttft_ms", "cache_verify_ms",
        F.col("cache_hit").alias("flag_ms"), F.col("model").alias("name_ms"), "prompt_tokens",
    )
    jsonl.append_events(rows, path)
    return rounded(metrics.stage_percentiles(metrics.stage_values(jsonl.scan_events(spark, path))))


def _benefit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Events 2i and 2i + 1 as the first and the repeated request of a question."""
    e = b.table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 2).cast("long").alias("q"), (F.col("event_id") % 2).alias("phase"), "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    miss = e.where("phase = 0").select("q", (F.col("value") * 20).alias("miss_ms"), (F.col("k") * 50).alias("miss_tokens"))
    hit = e.where("phase = 1").select(
        "q", (F.col("value") * 2).alias("hit_ms"), F.when(F.col("q") % 3 != 0, 0).otherwise(F.col("k")).alias("hit_tokens"),
        (F.col("q") % 5 != 0).alias("cache_hit"), F.when(F.col("q") % 4 == 0, "yes").when(F.col("q") % 4 == 1, "no").alias("verify_result"),
        F.when(F.col("q") % 4 < 2, F.col("k") + 5).alias("verify_tokens"),
    )
    return miss.join(hit, "q")


def cost_buckets(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("prompt_tokens")
    bucket = F.when(size < 30, "small").when(size < 60, "medium").otherwise("large")
    return metrics.cost_buckets(calls(spark, sf).withColumn("bucket", bucket))


QUERIES = {
    "usage_daily": usage_daily,
    "usage_summary": usage_summary,
    "result_summary": lambda s, sf: rounded(metrics.result_summary(calls(s, sf), ["workspace_id", "model"])),
    "result_counts": lambda s, sf: metrics.result_counts(calls(s, sf), ["workspace_id"]),
    "failure_distribution": lambda s, sf: metrics.failure_distribution(calls(s, sf)),
    "stage_percentiles": stage_percentiles,
    "llm_breakdown": lambda s, sf: rounded(metrics.call_breakdown(calls(s, sf))),
    "token_sums": lambda s, sf: metrics.token_sums(calls(s, sf)),
    "cost_buckets": cost_buckets,
    "cache_summary": lambda s, sf: rounded(metrics.cache_summary(calls(s, sf), ["workspace_id"])),
    "cache_benefit": lambda s, sf: rounded(metrics.cache_benefit(_benefit_pairs(s, sf))),
}

USAGE = """SELECT workspace_id, strftime(ts::DATE, '%Y-%m-%d') AS date, model AS embedding_model,
  sum(embedding_tokens::DECIMAL(12,1))::DOUBLE AS embedding_tokens FROM calls GROUP BY 1, 2, 3"""


def _pct(value: str, cond: str, name: str) -> str:
    return ", ".join(
        f"round(quantile_cont({value}, {p}) FILTER ({cond}), 6) AS {name}_p{round(p * 100)}" for p in (0.5, 0.95)
    )


ASKED = "cache_verify_result IS NOT NULL AND cache_verify_result <> 'limit'"
STAGES = " UNION ALL ".join(
    f"SELECT coalesce(purpose, 'other') AS event, '{s}' AS stage, {s} AS v FROM calls" for s in ("latency_ms", "total_ms", "ttft_ms", "cache_verify_ms")
)
ORACLE = {
    "usage_daily": f"WITH {CALLS} {USAGE}",
    "usage_summary": f"WITH {CALLS}, u AS ({USAGE}) SELECT * FROM u WHERE workspace_id = 'ws1'",
    "result_summary": f"""WITH {CALLS} SELECT workspace_id, model, count(*) AS total, count(*) FILTER (result = 'FAILED') AS failed,
      round(avg(CASE WHEN result <> 'FAILED' THEN 100.0::DOUBLE ELSE 0 END), 6) AS success_rate FROM calls WHERE result IS NOT NULL GROUP BY 1, 2""",
    "result_counts": f"WITH {CALLS} SELECT workspace_id, result, count(*) AS n FROM calls WHERE result IS NOT NULL GROUP BY 1, 2",
    "failure_distribution": f"""WITH {CALLS}, f AS (SELECT coalesce(nullif(failure_stage, ''), 'unknown') AS s, coalesce(nullif(error_type, ''), 'unknown') AS e FROM calls WHERE result = 'FAILED')
      SELECT 'failure_stage' AS dimension, s AS value, count(*) AS n FROM f GROUP BY 1, 2 UNION ALL SELECT 'error_type', e, count(*) FROM f GROUP BY 1, 2""",
    "stage_percentiles": f"""WITH {CALLS}, v AS ({STAGES}) SELECT event, stage, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95
      FROM v WHERE v IS NOT NULL GROUP BY 1, 2""",
    "llm_breakdown": f"""WITH {CALLS} SELECT coalesce(purpose, 'unknown') AS purpose, model, count(*) AS count, round(coalesce(avg(prompt_tokens), 0), 6) AS avg_prompt_tokens,
      round(coalesce(avg(completion_tokens), 0), 6) AS avg_completion_tokens, round(coalesce(avg(CASE WHEN parse_ok THEN 0.0::DOUBLE WHEN NOT parse_ok THEN 100 END), 0), 6) AS parse_failure_rate,
      count(*) FILTER (coalesce(error_type, '') <> '') AS error_count, round(coalesce(quantile_cont(latency_ms, 0.5), 0), 6) AS p50_latency_ms,
      round(coalesce(quantile_cont(latency_ms, 0.95), 0), 6) AS p95_latency_ms FROM calls GROUP BY 1, 2""",
    "token_sums": f"WITH {CALLS} SELECT purpose, model, count(*) AS calls, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM calls GROUP BY 1, 2",
    "cost_buckets": f"""WITH {CALLS}, b AS (SELECT *, unnest([CASE WHEN prompt_tokens < 30 THEN 'small' WHEN prompt_tokens < 60 THEN 'medium' ELSE 'large' END, 'all']) AS bucket FROM calls),
      c AS (SELECT bucket, count(*) AS calls, count(*) FILTER (coalesce(error_type, '') = '') AS ok_calls FROM b GROUP BY 1),
      l AS (SELECT bucket, unnest(['prompt_tokens', 'completion_tokens', 'latency_ms']) AS metric, unnest([prompt_tokens::DOUBLE, completion_tokens::DOUBLE, latency_ms]) AS v FROM b WHERE coalesce(error_type, '') = '')
      SELECT c.*, metric, count(v) AS n, round(avg(v), 1) AS mean, round(quantile_cont(v, 0.5), 1) AS p50, round(quantile_cont(v, 0.95), 1) AS p95
      FROM c JOIN l USING (bucket) WHERE v IS NOT NULL GROUP BY ALL""",
    "cache_summary": f"""WITH {CALLS} SELECT workspace_id, count(*) AS enabled_count, count(*) FILTER (cache_hit) AS hit_count,
      round(avg(CASE WHEN cache_hit THEN 100.0::DOUBLE ELSE 0 END), 6) AS hit_rate, count(*) FILTER ({ASKED}) AS verify_count,
      {', '.join(f"count(*) FILTER (cache_verify_result = '{o}') AS verify_{o}" for o in ('yes', 'no', 'invalid', 'error', 'timeout'))},
      count(*) FILTER (cache_verify_result = 'limit') AS verify_limited_count, count(*) FILTER (cache_hit AND cache_verify_result = 'yes') AS verify_hit_count,
      round(coalesce(avg(CASE WHEN cache_verify_result = 'yes' THEN 100.0::DOUBLE ELSE 0 END) FILTER (cache_hit), 0), 6) AS verify_hit_share,
      {_pct('total_ms', 'cache_hit', 'hit_total')}, {_pct('ttft_ms', 'cache_hit', 'hit_ttft')}, {_pct('total_ms', 'NOT cache_hit', 'miss_total')},
      {_pct('ttft_ms', 'NOT cache_hit', 'miss_ttft')}, {_pct('cache_verify_ms', ASKED, 'verify')} FROM calls WHERE cache_enabled GROUP BY 1""",
    "cache_benefit": """WITH e AS (SELECT event_id // 2 AS q, event_id % 2 AS phase, value, (props->>'$.k')::BIGINT AS k FROM events),
      p AS (SELECT m.q, m.value * 20 AS miss_ms, m.k * 50 AS mt, h.value * 2 AS hit_ms, CASE WHEN m.q % 3 <> 0 THEN 0 ELSE h.k END AS ht, m.q % 5 <> 0 AS hit,
              CASE m.q % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS vr, CASE WHEN m.q % 4 < 2 THEN h.k + 5 END AS vt
            FROM e m JOIN e h ON h.q = m.q AND h.phase = 1 WHERE m.phase = 0),
      a AS (SELECT count(*) AS questions, count(*) FILTER (hit) AS hit_count, count(*) FILTER (hit AND vr = 'yes') AS verified_hit_count, avg(mt) AS mt, avg(ht) AS ht,
        avg(hit_ms) FILTER (hit AND vr = 'yes') AS vh, avg(vt) AS vt, quantile_cont(miss_ms, 0.5) AS m50, quantile_cont(miss_ms, 0.95) AS m95,
        quantile_cont(hit_ms, 0.5) FILTER (hit) AS h50, quantile_cont(hit_ms, 0.95) FILTER (hit) AS h95 FROM p)
      SELECT questions, hit_count, verified_hit_count, round(mt, 6) AS mean_tokens_miss, round(ht, 6) AS mean_tokens_hit, round(vh, 6) AS mean_verified_hit_ms, round(vt, 6) AS mean_verify_tokens,
        round(m50, 6) AS miss_p50, round(m95, 6) AS miss_p95, round(h50, 6) AS hit_p50, round(h95, 6) AS hit_p95, round((mt - ht) / mt, 6) AS token_saving_rate, round(m50 / h50, 6) AS speedup_p50, h50 <= 2000 AS meets_target FROM a""",
}
