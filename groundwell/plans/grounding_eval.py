"""Quality of grounding decisions. "Not groundable" is the positive class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.operators.grounding import THRESHOLD, effective, final_decision

# Swept thresholds and confidence buckets.
THRESHOLDS = tuple(round(0.20 + 0.05 * i, 2) for i in range(9))
BUCKETS = (("bucket_00_05", 0.0, 0.5), ("bucket_05_08", 0.5, 0.8), ("bucket_08_10", 0.8, 1.0))


def _share(cond: Column, among: Column | None = None) -> Column:
    one = F.when(cond, 1.0).otherwise(0.0)
    return F.avg(one if among is None else F.when(among, one))


def metrics(records: DataFrame, thresholds: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per group and threshold.

    records: expected_groundable, top_similarity, llm_is_groundable, fallback_reason,
    llm_confidence, parse_ok, latency_ms, prompt_tokens, completion_tokens.
    """
    expected, sim = F.col("expected_groundable"), F.coalesce("top_similarity", F.lit(0.0))
    agree = effective() == expected
    parse_ok = F.coalesce("parse_ok", F.lit(True))
    conf = F.when(F.col("parse_ok"), F.col("llm_confidence"))

    def within(lo: float, hi: float) -> Column:
        upper = conf <= hi if hi == 1.0 else conf < hi
        return (conf >= lo) & upper

    fixed = {
        "total": F.count(F.lit(1)),
        "groundable_total": F.count_if(expected),
        "llm_only_agreement": _share(agree),
        "parse_failure_rate": _share(~parse_ok),
        **{name: _share(agree, within(lo, hi)) for name, lo, hi in BUCKETS},
        "mean_prompt_tokens": F.avg("prompt_tokens"),
        "mean_completion_tokens": F.avg("completion_tokens"),
        "mean_latency_ms": F.avg("latency_ms"),
    }
    cols, rows = [v.alias(k) for k, v in fixed.items()], []
    for i, t in enumerate(thresholds):
        final = final_decision(t)
        parts = {
            "correct": final == expected, "tp": ~final & ~expected, "fp": ~final & expected,
            "fn": final & ~expected, "blocked": expected & (sim < t), "below": sim < t,
        }
        cols += [F.count_if(c).alias(f"{n}_{i}") for n, c in parts.items()]
        rows.append(F.struct(F.lit(float(t)).alias("threshold"), *fixed, *(F.col(f"{n}_{i}").alias(n) for n in parts)))
    out = records.groupBy(*keys).agg(*cols).select(*keys, F.inline(F.array(*rows)))
    tp, fp, fn, zero = F.col("tp"), F.col("fp"), F.col("fn"), F.lit(0)
    out = out.withColumns(
        {
            "accuracy": F.col("correct") / F.col("total"),
            "precision": tp / F.nullif(tp + fp, zero),
            "recall": tp / F.nullif(tp + fn, zero),
            "filter_false_block_rate": F.col("blocked") / F.nullif("groundable_total", zero),
            "llm_call_saving_rate": F.col("below") / F.col("total"),
            "groundable_false_block_count": fp,
            "groundable_false_block_rate": fp / F.nullif("groundable_total", zero),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r))).drop("correct", "tp", "fp", "fn", "blocked", "below")


def false_block_by_category(records: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Share of answerable questions the similarity gate stops, per category and threshold."""
    rows = records.withColumn("category", F.coalesce("category", F.lit("unknown"))).where("expected_groundable")
    return metrics(rows, thresholds, ("category",)).select(
        "category", "threshold", F.col("filter_false_block_rate").alias("rate")
    )


def variants(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return metrics(records.withColumn("variant", F.coalesce("variant", F.lit("baseline"))), (threshold,), ("variant",))


def disagreements(records: DataFrame, names: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Cases on which variants decide differently, with a column per variant: right or not,
    NULL where the variant has no record."""
    decided = records.select(
        "id", "category", "expected_groundable",
        F.coalesce("variant", F.lit("baseline")).alias("variant"), final_decision(threshold).alias("final"),
        F.coalesce("repeat", F.lit(0)).alias("repeat"),
    )
    # A variant that ran a case repeatedly speaks with its last run.
    cases = decided.groupBy("id").agg(
        F.max("category").alias("category"),
        F.max("expected_groundable").alias("expected"),
        *(
            F.max_by("final", F.when(F.col("variant") == n, F.col("repeat"))).alias(n)
            for n in names
        ),
    )
    verdicts = F.array_distinct(F.array_compact(F.array(*names)))
    return cases.where(F.size(verdicts) > 1).select(
        "id", "category", "expected", *((F.col(n) == F.col("expected")).alias(n) for n in names)
    )


REPEAT_METRICS = (
    "accuracy", "recall", "f1", "groundable_false_block_rate", "mean_prompt_tokens", "mean_latency_ms",
    "parse_failure_rate",
)


def repeat_stats(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per variant and metric: n, mean, sample deviation (NULL for one repeat), min and max
    of the values of its repeats."""
    rows = records.withColumns(
        {"variant": F.coalesce("variant", F.lit("baseline")), "repeat": F.coalesce("repeat", F.lit(0))}
    )
    each = metrics(rows, (threshold,), ("variant", "repeat"))
    long = each.select(
        "variant",
        F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in REPEAT_METRICS))),
    )
    return long.groupBy("variant", "metric").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("stdev"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )


def _case_decisions(records: DataFrame, threshold: float) -> DataFrame:
    final = final_decision(threshold)
    return records.groupBy(F.coalesce("variant", F.lit("baseline")).alias("variant"), "id").agg(
        (F.min(final) != F.max(final)).alias("unstable")
    )


def flip_rates(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return _case_decisions(records, threshold).groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("unstable").alias("unstable"), _share(F.col("unstable")).alias("flip_rate")
    )


def unstable_cases(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return _case_decisions(records, threshold).where("unstable").select("variant", "id")
